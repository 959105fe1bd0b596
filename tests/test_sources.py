"""Listings with empty files, commits of concurrent writers, nulls under declared types, one-pass splits, counts for each rule."""

import hashlib
import pathlib
import threading

from pyspark.sql import functions as F

from pactum.contracts import floating, integer, string
from pactum.operators import checks, modes, refs, registry
from pactum.sources import files, keyed


def test_empty_files_are_listed(spark, tmp_path):
    for name, text in {"a/x y+z.txt": "hello", "a/empty.txt": "", "b/c/deep.txt": "1", "b/other.bin": "22", "d/only-empty.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    roots = [str(tmp_path / r) for r in ("a", "b", "d", "nowhere", "a")]
    got = [(pathlib.Path(r["path"]).name, r["length"]) for r in files.list_files(spark, roots, "*.txt").collect()]
    assert got == [("empty.txt", 0), ("x y+z.txt", 5), ("deep.txt", 1), ("only-empty.txt", 0)]


def test_null_under_a_declared_type(spark):
    df = spark.createDataFrame([(1, '{"k":null}'), (2, "{}"), (3, '{"k":1,"r":{"a":null}}'), (4, '{"k":1,"r":null}'), (5, '{"k":2,"r":{"a":"x"},"z":null}')], "i int, j string")
    good, bad = files.read_permissive(df, "j", "k long, r struct<a:string>")
    assert sorted(r["i"] for r in good.collect()) == [2, 5] and {r["i"]: r["error_class"] for r in bad.collect()} == dict.fromkeys((1, 3, 4), "TypeError")
    good, _ = files.read_permissive(df, "j", "k long, r struct<a:string>", optional=("k", "r.a"))
    assert sorted(r["i"] for r in good.collect()) == [1, 2, 3, 5]


def digest(path):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(path).rglob("*.parquet")}


def test_two_writers_leave_one_row_of_a_key(spark, tmp_path):
    table = lambda: keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "k long, who string")
    assert table().insert_if_absent(spark.createDataFrame([(1, "first"), (None, "null")], "k long, who string")) == 2
    before, added = digest(tmp_path), {}

    def write(who):
        rows = [(k, who) for k in (*range(6), None)] + [(100 + len(who), who)]
        added[who] = table().insert_if_absent(spark.createDataFrame(rows + rows, "k long, who string"))

    writers = [threading.Thread(target=write, args=("w" * n,)) for n in (1, 2, 3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    got = table().rows().collect()
    assert sorted((r["k"] is not None, r["k"] or 0) for r in got) == [(False, 0), *((True, k) for k in (0, 1, 2, 3, 4, 5, 101, 102, 103))]
    assert {r["k"]: r["who"] for r in got}[1] == "first" and sum(added.values()) == len(got) - 2
    assert before.items() <= digest(tmp_path).items()
    assert not [p for p in (tmp_path / "t/commits").iterdir() if p.name.startswith(".w")]


def test_a_number_is_claimed_once(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "k long")
    assert t._claim(0, "one") and not t._claim(0, "two") and t.commits() == ["one"]


def test_split_in_one_pass(spark, capsys):
    df = spark.range(100).withColumn("n", F.col("id") % 7)
    rules = checks.column_rules(df, n=integer(max=4))
    (good, bad), (good2, bad2) = modes.split(df, rules), modes.split_written(df, rules)
    assert good.columns == good2.columns and bad.columns == bad2.columns
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, good2.collect())) and sorted(r["id"] for r in bad.collect()) == sorted(r["id"] for r in bad2.collect())
    bad2.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(_part" in plan and "Range" not in plan


def test_counts_for_each_rule_in_batch_and_stream(spark, tmp_path):
    spark.range(60).select("id", (F.col("id") % 7).alias("n"), F.when(F.col("id") % 2 == 0, "ab").otherwise("a").alias("s")).repartition(6).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    n, s = checks.column_rules(df, n=integer(max=4))[0], checks.column_rules(df, s=string(min_length=2))[0]
    out, seen = modes.observed(df, [n, s], "q1", n_max=n, s_length=s)
    out.write.format("noop").mode("overwrite").save()
    summary = {r["path"]: r["n"] for r in modes.summary(df, [n, s]).collect()}
    assert (seen.get["n_max"], seen.get["s_length"]) == (summary["n"], summary["s"]) and seen.get["rows"] == 60
    listener = modes.QualityListener("q2")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    modes.observed_stream(stream, [n, s], "q2", n_max=n, s_length=s).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    assert len(listener.batches) == 3
    assert {k: sum(b[k] for b in listener.batches) for k in ("rows", "n_max", "s_length")} == {"rows": 60, "n_max": summary["n"], "s_length": summary["s"]}


def test_names_in_parts_of_bounded_size(spark):
    names = [("a", f"name{i:04d}") for i in range(500)] * 2 + [("b", "only"), ("b", None), (None, "x")]
    parts = registry.listing(spark.createDataFrame(names, "kind string, name string").repartition(7), "kind", "name", part_chars=90).collect()
    assert max(len(r["names"]) for r in parts) <= 100
    of = lambda kind: sorted((r["part"], r["first"], r["n"], r["names"]) for r in parts if r["kind"] == kind)
    assert [p for p, *_ in of("a")] == list(range(len(of("a")))) and sum(n for _, _, n, _ in of("a")) == 500
    assert ",".join(x for *_, x in of("a")) == ",".join(f"name{i:04d}" for i in range(500)) and all(x.startswith(f) for _, f, _, x in of("a"))
    assert of("b") == [(0, "only", 1, "only")] and of(None) == [(0, "x", 1, "x")]


def test_prefixes_make_their_matches_and_no_other_row(spark):
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)] + ["ab"]
    wants = ["", "a", "ab", ids[0][:12], ids[1], ids[1] + "0", "zz", None, ids[2][:4], ids[2][:4]]
    got = refs.prefix_matches(spark.createDataFrame([(w,) for w in wants], "want string"), spark.createDataFrame([(i,) for i in ids + ids], "sha string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, i) for w in {w for w in wants if w is not None} for i in ids if i.startswith(w))
    assert refs.prefix_matches(spark.createDataFrame([], "want string"), spark.createDataFrame([("a",)], "sha string")).count() == 0
