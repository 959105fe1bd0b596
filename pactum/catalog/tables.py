"""Aggregations, windows, sorts and set operations over entity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.operators import checks, registry


@query("SELECT r_name AS kind, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def available_names(t):
    df = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("kind"), "n_name")
    return registry.available_names(df, "kind", "n_name")


@query("SELECT substr(sha1(o_custkey::VARCHAR), 1, 2) AS prefix, count(DISTINCT sha1(o_custkey::VARCHAR))::BIGINT AS n_ids FROM orders GROUP BY 1")
def ambiguity_count(t):
    return registry.ambiguity_count(t.orders.select(F.sha1(F.col("o_custkey").cast("string")).alias("sha")), "sha", 2)


@query("""SELECT o_orderkey, '[' || '{"kind":"build","image":"img' || o_orderkey || '"}' || CASE WHEN o_orderkey % 2 = 0 THEN ',{"kind":"run","command":"' || o_orderstatus || '"}' ELSE '' END || ']' AS json FROM orders""")
def plan_to_json(t):
    build = t.orders.select("o_orderkey", F.lit(1).alias("seq"), F.lit("build").alias("kind"), F.concat(F.lit("img"), "o_orderkey").alias("image"))
    run = t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit(2).alias("seq"), F.lit("run").alias("kind"), F.col("o_orderstatus").alias("command"))
    return registry.plan_json([build, run], "o_orderkey", "seq")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_by_name(t):
    return registry.latest_by_name(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, role, max(CASE WHEN role <> 'assistant' AND turn > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations) WHERE role = 'assistant' AND b = 1""")
def header_order_violations(t):
    return registry.header_order_violations(t.conversations, "conv_id", "turn", F.col("role") == "assistant", F.col("turn") == 0).select("conv_id", "turn")


@query("""SELECT event_id, d - coalesce(lag(d) OVER w, 0) AS delta_line, CASE WHEN d = coalesce(lag(d) OVER w, 0) THEN m - coalesce(lag(m) OVER w, 0) ELSE m END AS delta_col
 FROM (SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS d, epoch_us(ts) % 86400000000 AS m FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY d, m, event_id)""")
def delta_encode_positions(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    df = t.events.select("event_id", "user_id", F.floor(us / F.lit(86_400_000_000)).alias("d"), F.pmod(us, F.lit(86_400_000_000)).alias("m"))
    return registry.delta_encoded(df, "user_id", "d", "m", "event_id").select("event_id", "delta_line", "delta_col")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def resume_skip_loaded(t):
    return registry.first_of_each_text(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT url FROM pages ORDER BY url")
def sorted_listing(t):
    return t.pages.select("url").orderBy("url")


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS pos, l_partkey AS label, p_name AS value, p_name IS NOT NULL AS ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20 ORDER BY 1, 2")
def ordered_results(t):
    from pactum.catalog.joins import order_refs

    return registry.ordered_results(order_refs(t), "l_orderkey", "refs", t.part.filter("p_size > 20"), "p_partkey", "p_name")


@query("""SELECT 'region' AS kind, r_name AS name, NULL::INT AS n_nationkey, NULL::DOUBLE AS s_acctbal FROM region UNION ALL SELECT 'nation', n_name, n_nationkey, NULL FROM nation UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier""")
def registry_union(t):
    kind = lambda k: F.lit(k).alias("kind")
    return registry.registry_union(t.region.select(kind("region"), F.col("r_name").alias("name")), t.nation.select(kind("nation"), F.col("n_name").alias("name"), "n_nationkey"), t.supplier.select(kind("supplier"), F.col("s_name").alias("name"), "s_acctbal"))


_NAMES = """SELECT 0 AS r, 'customer' AS source, CASE WHEN c_custkey % 10 = 0 THEN '_' || c_name ELSE 'n' || c_custkey % 700 END AS name FROM customer
 UNION ALL SELECT 1, 'supplier', 'n' || s_suppkey FROM supplier UNION ALL SELECT 2, 'part', p_brand FROM part"""


@query(f"SELECT name, arg_min(source, r) AS source FROM ({_NAMES}) WHERE NOT starts_with(name, '_') AND name NOT IN ('n7', 'Brand#11') GROUP BY name")
def priority_union_distinct(t):
    c = t.customer.select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("_"), "c_name")).otherwise(F.concat(F.lit("n"), F.col("c_custkey") % 700)).alias("name"))
    s = t.supplier.select(F.concat(F.lit("n"), "s_suppkey").alias("name"))
    return registry.priority_union([("customer", c), ("supplier", s), ("part", t.part.select(F.col("p_brand").alias("name")))], reserved=("n7", "Brand#11"))


@query("""WITH a AS (SELECT p_partkey AS type, p_partkey // 2 AS base, unnest([p_brand, p_type]) AS attr FROM part)
SELECT type, attr FROM (SELECT DISTINCT x.type, x.attr FROM a x JOIN a y ON y.type = x.base AND y.attr = x.attr)""")
def attr_conflicts(t):
    a = t.part.select(F.col("p_partkey").alias("type"), F.floor(F.col("p_partkey") / 2).alias("base"), F.explode(F.array("p_brand", "p_type")).alias("attr"))
    return registry.attr_conflicts(a).distinct()


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE 'a' END AS missing, CASE WHEN event_id % 3 = 0 THEN 'z' ELSE 'k,z' END AS extra FROM events")
def key_difference(t):
    k = F.col("event_id") % 3 == 0
    props = F.when(k, F.regexp_replace("props", '"k"', '"z"')).otherwise(F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "z": 1}')))
    missing = F.when(k, checks.missing_keys(props, "k")).otherwise(checks.missing_keys(props, "k", "a"))
    extra = F.when(k, checks.extra_keys(props, "k")).otherwise(checks.extra_keys(props, "a"))
    return t.events.select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query("""SELECT kind, string_agg(name, ',' ORDER BY name) AS names, count(*)::BIGINT AS n FROM (SELECT DISTINCT c_mktsegment AS kind, c_name AS name FROM customer) GROUP BY kind""")
def name_listing(t):
    """The names of each segment in parts of some hundred characters, put together again in the order of the parts."""
    parts = registry.listing(t.customer, "c_mktsegment", "c_name", part_chars=500)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "names"))), lambda s: s["names"])
    return parts.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.array_join(whole, ",").alias("names"), F.sum("n").alias("n"))
