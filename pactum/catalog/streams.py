"""Streams over the given tables, drained once into the shared folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.catalog.texts import EDITED, turn_edits
from pactum.contracts import floating, string
from pactum.operators import checks
from pactum.plans.scratch import scratch_dir
from pactum.streaming import streams


def fresh(t, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"



@contextlib.contextmanager
def keyed_state(t):
    """State of arbitrary kinds needs a store for it; the session's own setting is put back."""
    name, own = "spark.sql.streaming.stateStore.providerClass", t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        t.spark.conf.set(name, own) if own else t.spark.conf.unset(name)


def keyed(t, table: str, columns: list, name: str):
    """A written projection of a table, read as a stream: Spark's own file source wants folders."""
    at = fresh(t, name)
    getattr(t, table).select(*columns).write.parquet(at)
    return t.spark.readStream.schema(t.spark.read.parquet(at).schema).parquet(at)


@query("SELECT event_id, (value > 100)::INT + (event_type = 'click')::INT AS n_violations FROM events")
def stream_validate(t):
    s = keyed(t, "events", ["event_id", "event_type", "value"], "events-in")
    rules = checks.column_rules(s, value=floating(max=100.0), event_type=string(pattern="(?!click).*"))
    out = streams.run_once(streams.validated(s, rules), fresh(t, "events-out"), fresh(t, "events-at"))
    return out.select("event_id", F.size("_violations").alias("n_violations"))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 3 AS version, event_id % 11 = 0 AS gone, props FROM events),
p AS (SELECT *, lag(version) OVER w AS was, lag(gone) OVER w AS was_gone FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id::VARCHAR AS key, event_id AS seq, CASE WHEN gone THEN was ELSE version END AS version, CASE WHEN gone THEN 'removed' WHEN was IS NULL OR was_gone THEN 'added' ELSE 'replaced' END AS change, CASE WHEN NOT gone THEN props END AS text FROM p
 WHERE CASE WHEN gone THEN was IS NOT NULL AND NOT was_gone ELSE was IS NULL OR was_gone OR was <> version END""")
def stream_versioned_state(t):
    k = F.col("event_id")
    s = keyed(t, "events", [F.col("user_id").cast("string").alias("key"), k.alias("seq"), (k % 3).alias("version"), F.when(k % 11 == 0, "remove").otherwise("update").alias("op"), F.col("props").alias("text")], "versions-in")
    with keyed_state(t):
        return streams.run_once(streams.versioned(s, "key"), fresh(t, "versions-out"), fresh(t, "versions-at"))


@query(f"SELECT conv_id::VARCHAR AS key, edits, text FROM ({EDITED})")
def stream_edit_fold(t):
    """All turns of all conversations that begin with the first one; the last text of each is kept."""
    at = fresh(t, "edits-in")
    begun = t.conversations.filter("turn = 0").select("conv_id").distinct()
    turn_edits(t).join(begun, "conv_id", "left_semi").withColumn("key", F.col("conv_id").cast("string")).drop("conv_id").write.parquet(at)
    s = t.spark.readStream.schema(t.spark.read.parquet(at).schema).parquet(at)
    with keyed_state(t):
        out = streams.run_batches(streams.edit_folded(s, "key"), fresh(t, "edits-out"), fresh(t, "edits-at"))
    return out.groupBy("key").agg(F.max("edits").alias("edits"), F.max_by("text", "edits").alias("text"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_skip_seen(t):
    s = keyed(t, "events", ["user_id", "event_type"], "seen-in")
    return streams.run_once(streams.skip_seen(s, "user_id", "event_type"), fresh(t, "seen-out"), fresh(t, "seen-at"))


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_new_files(t):
    """Files arrive two at a time; with each arrival the registry of users is rebuilt from what has come so far."""
    at, seen = fresh(t, "files-in"), fresh(t, "files-seen")
    t.events.select("event_id", "user_id").repartition(6).write.parquet(at)
    s = streams.new_files(t.spark, at, t.spark.read.parquet(at).schema, per_batch=2)
    latest = streams.LatestRegistry(lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")))

    def arrived(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{seen}/epoch={epoch}")
        latest.batch(t.spark.read.schema(batch.schema).option("basePath", seen).parquet(*(f"{seen}/epoch={k}" for k in range(epoch + 1))), epoch)

    s.writeStream.foreachBatch(arrived).option("checkpointLocation", fresh(t, "files-at")).trigger(availableNow=True).start().awaitTermination()
    return latest.current


@query("SELECT event_id, c_name, c_name IS NOT NULL AS found FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id")
def stream_lookup(t):
    s = keyed(t, "events", ["event_id", "user_id"], "lookup-in")
    reg = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name")
    return streams.run_once(streams.looked_up(s, "user_id", reg, "c_custkey"), fresh(t, "lookup-out"), fresh(t, "lookup-at")).select("event_id", "c_name", "found")
