import random
import time

from pyspark.sql import functions as F

from pactum.contracts import integer
from pactum.operators import checks, modes, text
from pactum.streaming import streams


def test_stream_equals_batch_with_two_sinks(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(50).withColumn("n", F.col("id") % 7).write.parquet(src)
    stream = spark.readStream.schema("id long, n long").parquet(src)
    rules = checks.column_rules(stream, n=integer(max=4))
    streams.write_validated(stream, rules, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    good, bad = modes.split(spark.read.parquet(src), rules)
    assert spark.read.parquet(str(tmp_path / "ok/epoch=0")).count() == good.count()
    assert spark.read.parquet(str(tmp_path / "bad/epoch=0")).count() == bad.count()


def test_versions_and_edits_carry_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, seq long, version long, op string, text string"
    rows = [[("u", 1, 1, "update", "a"), ("u", 2, 1, "update", "ignored")], [("u", 3, 0, "update", "b"), ("u", 4, 0, "remove", None), ("v", 5, 1, "update", "c")]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        got = streams.run_once(streams.versioned(spark.readStream.schema(schema).parquet(src), "key"), out, str(tmp_path / "at"))
    assert sorted((r.key, r.seq, r.change) for r in got.collect()) == [("u", 1, "added"), ("u", 3, "replaced"), ("u", 4, "removed"), ("v", 5, "added")]


def test_a_failed_rebuild_leaves_no_registry(spark):
    def rebuild(rows):
        if rows.count() == 0:
            raise ValueError("nothing")
        return rows

    latest = streams.LatestRegistry(rebuild)
    latest.batch(spark.range(2), 0)
    assert latest.current is not None
    try:
        latest.batch(spark.range(0), 1)
    except ValueError:
        pass
    assert latest.current is None


EDITS = "key string, seq long, start_line int, start_col int, end_line int, end_col int, text string"


def fold(spark, tmp_path, batches, texts=True):
    """The rows of each batch of edits, in order, over one checkpoint; every batch is a new query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, EDITS).coalesce(1).write.mode("append").parquet(src)
        got = streams.run_batches(streams.edit_folded(spark.readStream.schema(EDITS).parquet(src), "key", texts), out, str(tmp_path / "at"))
    return got


def test_edits_of_a_stream_equal_the_batch_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows, batches = [], []
    for b in range(3):
        batch = [("k%d" % rng.randrange(3), 100 * b + i, rng.randrange(4), rng.randrange(9), rng.randrange(5), rng.randrange(9), rng.choice(["", "x", "ab\nc", None])) for i in range(12)]
        if b:
            batch.append(("k0", 100 * b + 50, None, None, None, None, "all\nnew"))
        rows += batch
        batches.append(batch)
    got = fold(spark, tmp_path, batches)
    last = {r["key"]: r["text"] for r in got.groupBy("key").agg(F.max_by("text", "edits").alias("text")).collect()}
    assert last == {r["key"]: r["text"] for r in text.apply_edit_log(spark.createDataFrame(rows, EDITS), "key").collect()}


def test_a_batch_writes_what_its_edits_change(spark, tmp_path):
    long = "one line of the text\n" * 20_000
    got = fold(spark, tmp_path, [[("k", 1, None, None, None, None, long)], [("k", 2, 10_000, 3, 10_000, 3, "X"), ("k", 3, 10_001, 0, 10_001, 3, "")]], texts=False)
    first, second = sorted(got.collect(), key=lambda r: r["edits"])
    assert (first["pieces_written"], first["chars"]) == (-(-len(long) // 4096), len(long))
    assert second["pieces_before"] > 100 and second["pieces_written"] <= 3 and second["chars"] == len(long) - 2 and second["text"] is None


def test_keys_seen_lately_are_skipped_and_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))

    def run(rows, ttl_ms):
        spark.createDataFrame(rows, "k string, n long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, n long").parquet(src)
        return sorted((r["k"], r["n"]) for r in streams.run_once(streams.skip_seen_lately(stream, "k", ttl_ms=ttl_ms), out, at).collect())

    # else a query with processing time goes on without data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    assert run([("a", 1), ("b", 1)], 4000) == [("a", 1), ("b", 1)]
    time.sleep(5)
    assert run([("a", 2)], 4000) == [("a", 1), ("a", 2), ("b", 1)]
    assert run([("a", 3), ("c", 3)], 600_000) == [("a", 1), ("a", 2), ("b", 1), ("c", 3)]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
