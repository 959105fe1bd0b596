"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.contracts import field, floating, integer, record, string
from pactum.operators import refs, registry, text
from pactum.operators.canonical import qualified_key
from pactum.plans.scratch import scratch_dir
from pactum.sources import files, keyed, values


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def read_value(t):
    order = record(field("o_orderkey", integer()), field("o_custkey", integer()), field("o_totalprice", floating()), field("o_orderstatus", string()))
    return values.read_value(t.spark, values.Value("orders", order, values.Location("posix", {"path": f"{t.dir}/orders.parquet"})))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def write_value(t):
    order = record(field("o_orderkey", integer()), field("o_totalprice", floating()))
    out = values.Value("finished", order, values.Location("posix", {"path": f"{scratch_dir(t.spark)}/finished-{uuid.uuid4().hex}"}))
    values.write_value(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), out)
    return values.read_value(t.spark, out)


@query()
def list_files(t):
    found = files.list_files(t.spark, [t.dir, f"{t.dir}/no-such-folder"], "*.parquet")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "length")


@query("SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def read_text_lines(t):
    return text.text_lines(t.documents, "doc_id", "text")


@query("""SELECT sha1(o_orderkey::VARCHAR) AS sha, CASE WHEN o_orderkey % 3 = 0 THEN 'refs/tags/t' ELSE 'refs/heads/b' END || o_orderkey AS ref FROM orders WHERE o_orderkey % 5 <> 0
 UNION ALL SELECT sha1(o_orderkey::VARCHAR), 'refs/heads/b' || o_orderkey FROM orders WHERE o_orderkey % 7 <> 0""")
def parse_ref_listing(t):
    sha, key = F.sha1(F.col("o_orderkey").cast("string")), F.col("o_orderkey")
    ref = F.concat(F.when(key % 3 == 0, "refs/tags/t").otherwise("refs/heads/b"), key)
    lines = t.orders.select(F.when(key % 5 == 0, F.concat(sha, ref)).otherwise(F.concat(sha, F.lit("\t"), ref)).alias("line"))
    tracked = t.orders.select(F.concat(sha, F.lit(" "), F.when(key % 7 == 0, "refs/remotes/origin/HEAD").otherwise(F.concat(F.lit("refs/remotes/origin/b"), key))).alias("line"))
    return refs.parse_ref_listing(lines).unionByName(refs.parse_tracking_refs(tracked))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 8 NOT IN (1, 3, 5, 7) AND event_id % 16 <> 2 THEN (props->>'$.k')::BIGINT END AS k,
 CASE WHEN event_id % 4 = 0 THEN 'ParseError' WHEN event_id % 8 IN (1, 3, 5, 7) THEN 'TypeError' END AS error_class FROM events""")
def read_permissive(t):
    """Broken text, JSON that is no object, a value of another type and a null fail each in its way; none stops the others, and a field may be absent."""
    k = F.col("event_id")
    said = F.when(k % 4 == 0, F.concat(F.lit("{"), "props")).when(k % 8 == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k % 8 == 3, F.concat(F.lit('{"k":"'), k, F.lit('x"}'))).when(k % 8 == 5, k.cast("string")).when(k % 8 == 7, '{"k":null}').when(k % 16 == 2, "{}").otherwise(F.col("props"))
    good, bad = files.read_permissive(t.events.select("event_id", said.alias("props")), "props", "k long")
    return good.select("event_id", "parsed.k", F.lit(None).cast("string").alias("error_class")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"), "error_class"))


@query("""SELECT 'nation/geo/nation:' || n_name AS key, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","region":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"},"pair":[' || n_nationkey || ',' || n_regionkey || ']}' AS json
 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def registry_to_json(t):
    df = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    df = df.select("n_nationkey", "n_name", F.struct("r_regionkey", "r_name").alias("region"), F.array("n_nationkey", "n_regionkey").alias("pair"))
    return registry.registry_json(df, "nation", qualified_key(F.lit("geo/nation.def"), F.col("n_name")))


@query("""SELECT c_custkey, c_name AS origin FROM customer WHERE c_acctbal > 0
 UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def insert_if_absent(t):
    """Customers in credit are in the table; whoever ordered is added unless there, twice over, and nothing there changes."""
    table = keyed.KeyedTable(t.spark, f"{scratch_dir(t.spark)}/keyed-{uuid.uuid4().hex}", ["c_custkey"], "c_custkey long, origin string")
    table.insert_if_absent(t.customer.filter("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("origin")))
    for _ in range(2):
        table.insert_if_absent(t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("orders").alias("origin")))
    return table.rows()
