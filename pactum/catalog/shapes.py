"""Projections, canonical forms, record shapes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.contracts import derive, string
from pactum.operators import canonical, labels, refs, text

EMAIL = derive("email", string(), canonical=lambda c: F.lower(canonical.stripped(c)))


@query("SELECT c_custkey, lower(c_name) AS name, CASE WHEN length(c_mktsegment) = 8 THEN c_mktsegment END AS eight FROM customer")
def canonicalize(t):
    eight = derive("eight", string(), canonical=lambda c: F.when(F.length(c) == 8, c))
    padded = F.concat(F.lit("\t \n"), F.upper("c_name"), F.lit(" \r"))
    return t.customer.select("c_custkey", canonical.canonicalize(EMAIL, padded).alias("name"), canonical.canonicalize(eight, F.col("c_mktsegment")).alias("eight"))


@query("SELECT p_partkey, round_even(p_size + 0.5, 0)::DOUBLE AS half, upper(p_brand) AS p_brand FROM part")
def canonicalize_record(t):
    df = t.part.select("p_partkey", (F.col("p_size") + 0.5).cast("double").alias("half"), "p_brand")
    return canonical.canonicalize_record(df, half=lambda c: F.bround(c, 0), p_brand=F.upper)


@query("SELECT page_id, lower(url) AS plain, upper(url) AS loud FROM pages")
def canonical_inherit(t):
    child = derive("child", EMAIL)
    loud = derive("loud", child, canonical=lambda c: F.upper(canonical.stripped(c)))
    padded = F.concat(F.lit("  "), "url", F.lit("\n"))
    return t.pages.select("page_id", canonical.canonicalize(child, padded).alias("plain"), canonical.canonicalize(loud, padded).alias("loud"))


@query("SELECT n_nationkey, r_name AS region_name, n_regionkey AS second FROM nation JOIN region ON n_regionkey = r_regionkey")
def struct_build(t):
    df = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    region = canonical.record_of(r_regionkey=F.col("r_regionkey"), r_name=F.col("r_name"))
    built = df.select("n_nationkey", canonical.record_of(region=region, pair=F.array("n_nationkey", "n_regionkey")).alias("s"))
    return built.select("n_nationkey", F.col("s.region.r_name").alias("region_name"), F.col("s.pair")[1].alias("second"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'no such field' END AS error FROM events")
def struct_get_path(t):
    path = F.when(F.col("event_id") % 2 == 0, "$.k").otherwise("$.z")
    v = F.parse_json("props")
    got = F.try_variant_get(v, path, "bigint")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.when(got.isNull(), "no such field").alias("error"))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","keys":[' || n_nationkey || ',' || n_regionkey || '],"none":null}' AS json FROM nation""")
def struct_to_json(t):
    s = F.struct("n_name", F.array("n_nationkey", "n_regionkey").alias("keys"), F.lit(None).cast("string").alias("none"))
    return t.nation.select("n_nationkey", F.to_json(s, {"ignoreNullFields": "false"}).alias("json"))


@query("SELECT n_nationkey, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def struct_to_map(t):
    m = F.map_from_arrays(F.array(F.lit("n_name"), F.lit("n_regionkey")), F.array("n_name", F.col("n_regionkey").cast("string")))
    return t.nation.select("n_nationkey", F.explode(m).alias("field", "value"))


@query("SELECT n_nationkey, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def flatten_fields(t):
    return canonical.flatten_fields(t.nation, ["n_nationkey"], "n_name", "n_regionkey")


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS same FROM orders")
def struct_equal(t):
    k = F.col("o_orderkey")
    a = {"x": F.col("o_totalprice"), "y": F.when(k % 3 == 0, F.col("o_orderstatus"))}
    b = {"y": F.when(k % 3 == 0, F.col("o_orderstatus")), "x": F.col("o_totalprice") + k % 2}
    return t.orders.select("o_orderkey", canonical.record_equal(a, b).alias("same"))


@query("""SELECT n_nationkey, md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""")
def struct_fingerprint(t):
    return t.nation.select("n_nationkey", canonical.fingerprint(t.nation, "n_regionkey", "n_name", "n_nationkey").alias("fingerprint"))


@query("""SELECT event_id, 'k' AS key, CASE WHEN event_id % 2 = 0 THEN -1 ELSE (props->>'$.k')::BIGINT END AS value FROM events UNION ALL SELECT event_id, 'n', event_id FROM events""")
def merge_attributes(t):
    base = t.events.select("event_id", F.lit("k").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("value"))
    over = t.events.filter("event_id % 2 = 0").select("event_id", F.lit("k").alias("key"), F.lit(-1).cast("long").alias("value")).unionByName(t.events.select("event_id", F.lit("n").alias("key"), F.col("event_id").alias("value")))
    return canonical.merge_attributes(base, over, ["event_id", "key"])


@query("SELECT o_orderkey, 'r1' AS _run, 'main' AS _branch, 'orders' AS source FROM orders")
def stamp_provenance(t):
    df = canonical.stamped(t.orders, from_files=True, run="r1", branch="main")
    return df.select("o_orderkey", "_run", "_branch", F.regexp_extract("_file", r"/(orders)\.parquet", 1).alias("source"))


@query("SELECT n_nationkey, 'geo/nation:' || n_name AS key, 'value/geo/nation:' || n_name AS global_key FROM nation")
def qualified_key(t):
    stem = F.lit("geo/nation.def")
    return t.nation.select("n_nationkey", canonical.qualified_key(stem, F.col("n_name")).alias("key"), canonical.qualified_key(stem, F.col("n_name"), F.lit("value")).alias("global_key"))


def part_labels(t):
    k = F.col("p_partkey")
    shape = (
        F.when(k % 8 == 0, F.concat(F.lit("@root"), k % 5, F.lit("//pkg/"), k, F.lit(":part.brand.name")))
        .when(k % 8 == 1, F.concat(F.lit("//pkg:t"), k))
        .when(k % 8 == 2, F.concat(F.lit(":t"), k, F.lit(".f")))
        .when(k % 8 == 3, "")
        .when(k % 8 == 4, F.concat(F.lit("@lex"), k))
        .when(k % 8 == 5, F.concat(F.lit("//pkg"), k))
        .when(k % 8 == 6, "//pkg:")
        .otherwise(F.concat(F.lit("@//:x"), k))
    )
    return t.part.select("p_partkey", shape.alias("label"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'root' || p_partkey % 5 WHEN 7 THEN '' END AS root,
 CASE p_partkey % 8 WHEN 0 THEN 'pkg/' || p_partkey WHEN 1 THEN 'pkg' WHEN 7 THEN '' END AS package,
 CASE p_partkey % 8 WHEN 0 THEN 'part' WHEN 1 THEN 't' || p_partkey WHEN 2 THEN 't' || p_partkey WHEN 7 THEN 'x' || p_partkey END AS target,
 CASE p_partkey % 8 WHEN 0 THEN 'brand/name' WHEN 1 THEN '' WHEN 2 THEN 'f' WHEN 7 THEN '' END AS fields,
 CASE p_partkey % 8 WHEN 3 THEN 'empty label' WHEN 4 THEN '@ without //' WHEN 5 THEN '// without :' WHEN 6 THEN 'empty target' END AS error FROM part""")
def parse_target(t):
    df = part_labels(t).withColumn("p", labels.parse_target(F.col("label")))
    return df.select("p_partkey", "p.root", "p.package", "p.target", F.array_join("p.fields", "/").alias("fields"), "p.error")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN NULL END AS ref, CASE p_partkey % 4 WHEN 0 THEN '//p:t' || p_partkey WHEN 1 THEN '@r//p:t|x' END AS inner_label,
 CASE p_partkey % 4 WHEN 2 THEN 'no separator' WHEN 3 THEN 'bad inner label' END AS error FROM part""")
def parse_label(t):
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("main|//p:t"), k)).when(k % 4 == 1, "@r//p:t|x").when(k % 4 == 2, "x").otherwise("main|p:t")
    return t.part.select("p_partkey", labels.parse_label(label).alias("p")).select("p_partkey", "p.ref", F.col("p.inner").alias("inner_label"), "p.error")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'roots/a/' || p || '/f' WHEN 1 THEN 'pkg/' || p WHEN 2 THEN 'src/d/' || p WHEN 3 THEN 'src/' || p END AS resolved,
 CASE page_id % 6 WHEN 4 THEN 'unknown root' WHEN 5 THEN 'above the root' END AS load_error FROM (SELECT page_id, regexp_replace(url, '[^a-z0-9]+', '_', 'g') AS p FROM pages)""")
def resolve_load_path(t):
    """A load of each form, with a name made of the page's address."""
    k, name = F.col("page_id") % 6, F.regexp_replace("url", "[^a-z0-9]+", "_")
    said = lambda before, after="": F.concat(F.lit(before), name, F.lit(after))
    path = F.when(k == 0, said("@A//", ":f")).when(k == 1, said("//pkg:")).when(k == 2, said(":")).when(k == 3, said("./x/../../")).when(k == 4, said("@Z//p:")).otherwise(said("../../../"))
    df = t.pages.select("page_id", path.alias("path"), F.lit("src/d/here").alias("file"))
    roots = t.region.filter("r_regionkey < 2").select(F.upper(F.element_at(F.split("r_name", ""), 1)).alias("name")).filter("name = 'A'").distinct().withColumn("path", F.lit("roots/a"))
    return labels.resolve_load_path(df, "path", "file", roots).select("page_id", "resolved", "load_error")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) THEN 'local/' ELSE 'remote/' END || o_orderkey AS location FROM orders")
def pick_materialization(t):
    have = t.lineitem.filter("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    k = F.col("o_orderkey")
    return refs.pick_materialization(t.orders.select("o_orderkey"), "o_orderkey", have, F.concat(F.lit("local/"), k), F.concat(F.lit("remote/"), k))


@query("SELECT o_orderkey, (o_orderkey % 3)::VARCHAR AS major, (o_orderkey % 10)::VARCHAR AS minor, (o_orderkey % 7)::VARCHAR AS patch, CASE WHEN o_orderkey % 2 = 0 THEN 'rc.' || o_orderkey ELSE '' END AS prerelease, CASE WHEN o_orderkey % 4 = 0 THEN 'b' || o_orderkey ELSE '' END AS build FROM orders")
def named_group_extract(t):
    k = F.col("o_orderkey")
    version = F.concat(k % 3, F.lit("."), k % 10, F.lit("."), k % 7, F.when(k % 2 == 0, F.concat(F.lit("-rc."), k)).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit("+b"), k)).otherwise(""))
    number, ids = r"(0|[1-9]\d*)", r"([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)"
    pattern = rf"\A{number}\.{number}\.{number}(?:-{ids})?(?:\+{ids})?\z"
    names = ("major", "minor", "patch", "prerelease", "build")
    return t.orders.select("o_orderkey", version.alias("v")).select("o_orderkey", text.named_groups(F.col("v"), pattern, *names).alias("g")).select("o_orderkey", "g.*")
