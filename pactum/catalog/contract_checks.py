"""Contract checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.contracts import abstract, boolean, derive, field, floating, integer, mapping, record, string, tuple_of, vector
from pactum.operators import canonical, checks, labels, modes, registry
from pactum.sources.values import Location, location_violation

LINE = ["l_orderkey", "l_linenumber"]


def bad(df, keys, **types):
    return modes.all_violations(df, checks.column_rules(df, **types), *keys)


@query("""SELECT l_orderkey, l_linenumber, 'l_linenumber' AS path, 'max' AS rule, 'ValueError' AS error_class, 'above 5' AS message FROM lineitem WHERE l_linenumber > 5
UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', 'kind', 'TypeError', 'not integer' FROM lineitem""")
def check_integer(t):
    return bad(t.lineitem, LINE, l_linenumber=integer(min=1, max=5), l_quantity=integer())


@query("""SELECT l_orderkey, l_linenumber, 'l_quantity' AS path, 'max' AS rule, 'ValueError' AS error_class FROM lineitem WHERE l_quantity > 30
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'min', 'ValueError' FROM lineitem WHERE l_discount < 0.02
UNION ALL SELECT l_orderkey, l_linenumber, 'l_linenumber', 'kind', 'TypeError' FROM lineitem""")
def check_float(t):
    return bad(t.lineitem, LINE, l_quantity=floating(max=30.0), l_discount=floating(min=0.02), l_linenumber=floating()).drop("message")


@query("SELECT l_orderkey, l_linenumber, 'l_tax' AS path, 'kind' AS rule, 'TypeError' AS error_class FROM lineitem")
def check_bool(t):
    df = t.lineitem.withColumn("returned", F.col("l_returnflag") == "R")
    return bad(df, LINE, returned=boolean(), l_tax=boolean()).drop("message")


@query("""SELECT doc_id, 'text' AS path, CASE WHEN length(text) < 300 THEN 'min_length' ELSE 'max_length' END AS rule FROM documents WHERE length(text) < 300 OR length(text) > 5000""")
def check_string_length(t):
    return bad(t.documents, ["doc_id"], text=string(min_length=300, max_length=5000)).select("doc_id", "path", "rule")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3]\\d')")
def check_string_pattern(t):
    df = t.part
    return modes.first_violation(df, checks.column_rules(df, p_brand=string(pattern=r"Brand#[1-3]\d"))).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def check_enum(t):
    priority = derive("priority", string(), predicate=lambda c: c.isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return modes.first_violation(t.orders, checks.column_rules(t.orders, o_orderpriority=priority)).select("o_orderkey", "o_orderpriority")


@query("SELECT vec_id, len(embedding)::INT AS n FROM embeddings WHERE len(embedding) > 60")
def check_vector_length(t):
    return modes.first_violation(t.embeddings, checks.column_rules(t.embeddings, embedding=vector(min_length=1, max_length=60))).select("vec_id", F.size("embedding").alias("n"))


@query("""SELECT vec_id, 'embedding[' || i || ']' AS path, 'max' AS rule FROM (
 SELECT vec_id, list_position(list_transform(embedding, lambda x: x > 0.25), true) - 1 AS i FROM embeddings) WHERE i >= 0""")
def check_vector_elements(t):
    return bad(t.embeddings, ["vec_id"], embedding=vector(element=floating(max=0.25))).select("vec_id", "path", "rule")


@query("""SELECT vec_id, 'pair[' || i || ']' AS path, 'min' AS rule FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS b FROM embeddings), (VALUES (0), (1)) v(i)
 WHERE CASE WHEN i = 0 THEN a < 0 ELSE b < 0 END""")
def check_tuple(t):
    df = t.embeddings.select("vec_id", F.struct(F.col("embedding")[0].alias("_1"), F.col("embedding")[1].alias("_2")).alias("pair"))
    return bad(df, ["vec_id"], pair=tuple_of(floating(min=0.0), floating(min=0.0))).select("vec_id", "path", "rule")


@query("SELECT event_id, 'props.k' AS path, 'pattern' AS rule FROM events WHERE event_id % 3 = 0")
def check_map_keys(t):
    props = F.from_json("props", "map<string,bigint>")
    df = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.transform_keys(props, lambda k, v: F.upper(k))).otherwise(props).alias("props"))
    return bad(df, ["event_id"], props=mapping(key=string(pattern="[A-Z]+"))).select("event_id", "path", "rule")


@query("SELECT event_id, 'props.k' AS path, 'max' AS rule FROM events WHERE (props->>'$.k')::BIGINT > 50")
def check_map_values(t):
    df = t.events.select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return bad(df, ["event_id"], props=mapping(value=integer(max=50))).select("event_id", "path", "rule")


@query("SELECT d.doc_id, 'missing' AS rule, 'quality,toxic' AS message FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def check_required_fields(t):
    df = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")
    need = record(field("toxic", integer()), field("quality", integer()), field("doc_id", integer()))
    return modes.all_violations(df, checks.row_rules(df, need), "doc_id").select("doc_id", "rule", "message")


@query("""SELECT event_id, 'props' AS path, 'extra' AS rule, 'k' AS message FROM events WHERE json_exists(props, '$.k')
 UNION ALL SELECT event_id, 'props', 'missing', 'unit' FROM events""")
def check_strict_fields(t):
    """A strict record contract over each event's own keys: ``unit`` must be there, ``z`` may, others may not."""
    contract = record(field("unit", string()), field("z", string(), mandatory=False), strict=True)
    df = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return modes.all_violations(df, checks.column_rules(df, props=contract), "event_id").select("event_id", "path", "rule", "message")


@query("SELECT d.doc_id, 'quality' AS path, 'min' AS rule FROM documents d JOIN labels l USING (doc_id) WHERE l.quality < 1")
def check_optional_fields(t):
    df = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    c = record(field("doc_id", integer()), field("quality", integer(min=1), mandatory=False))
    return modes.all_violations(df, checks.row_rules(df, c), "doc_id").select("doc_id", "path", "rule")


@query("""SELECT c_custkey, 'c_acctbal' AS path, 'min' AS rule FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'predicate' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'c_nationkey', 'max' FROM customer WHERE c_nationkey > 20
UNION ALL SELECT c_custkey, '', 'extra' FROM customer""")
def check_record(t):
    segment = derive("segment", string(), predicate=lambda c: c.isin("BUILDING", "MACHINERY"))
    c = record(field("c_custkey", integer(min=0)), field("c_nationkey", integer(min=0, max=20)), field("c_acctbal", floating(min=0.0)), field("c_mktsegment", segment), strict=True)
    return modes.all_violations(t.customer, checks.row_rules(t.customer, c), "c_custkey").select("c_custkey", "path", "rule")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS m, c_nationkey AS n, c_acctbal AS b FROM customer)
SELECT k, 'doc' AS path, 'extra' AS rule, 'ValueError' AS error_class, 'z' AS message FROM c WHERE m = 5
UNION ALL SELECT k, 'doc', 'missing', 'ValueError', 'nation' FROM c WHERE m = 1
UNION ALL SELECT k, 'doc.nation', 'kind', 'TypeError', 'not integer' FROM c WHERE m IN (2, 3)
UNION ALL SELECT k, 'doc.nation', 'max', 'ValueError', 'above 20' FROM c WHERE m IN (0, 4, 5) AND n > 20
UNION ALL SELECT k, 'doc.lines[1].n', 'kind', 'TypeError', 'not integer' FROM c WHERE m = 4 AND n >= 3
UNION ALL SELECT k, 'doc.lines[0].n', 'min', 'ValueError', 'below 3' FROM c WHERE n < 3
UNION ALL SELECT k, 'doc', 'predicate', 'ValueError', 'predicate is false' FROM c WHERE m IN (0, 4, 5) AND n % 5 = 0""", "check_variant_record")
def check_variant_record(t):
    """A nested, strict record contract over JSON documents of customers: null, float and absent nations, lines of mixed kinds, unknown keys."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    nation = F.when(k % 6 == 1, "").when(k % 6 == 2, '"nation":null,').when(k % 6 == 3, F.concat(F.lit('"nation":'), n, F.lit(".0,"))).otherwise(F.concat(F.lit('"nation":'), n, F.lit(",")))
    second = F.when(k % 6 == 4, "true").otherwise("7")
    text = F.concat(F.lit("{"), nation, F.when(k % 6 == 5, '"z":1,').otherwise(""), F.lit('"lines":[{"n":'), n, F.lit('},{"n":'), second, F.lit("}]}"))
    contract = record(field("nation", integer(max=20)), field("lines", vector(element=record(field("n", integer(min=3))))), strict=True, predicate=lambda r: r["nation"] % 5 != 0)
    # few bytes and much work in a row: one file of customers is one or two tasks, whatever its rows
    rows = t.customer.select("c_custkey", "c_nationkey").repartition(4 * t.spark.sparkContext.defaultParallelism)
    df = rows.select(k.alias("k"), F.parse_json(text).alias("doc"))
    return modes.all_violations(df, checks.column_rules(df, doc=contract), "k")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 <> 0")
def check_predicate(t):
    even = derive("even", integer(), predicate=lambda c: F.pmod(c, F.lit(2)) == 0)
    return modes.first_violation(t.part, checks.column_rules(t.part, p_size=even)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice < l_quantity * 1000")
def check_cross_field(t):
    c = record(field("l_quantity", floating()), field("l_extendedprice", floating()), predicate=lambda r: r["l_extendedprice"] >= r["l_quantity"] * 1000)
    df = t.lineitem
    return modes.all_violations(df, checks.row_rules(df, c), *LINE).select(*LINE)


@query("""SELECT l_orderkey, l_linenumber, rule FROM (
 SELECT l_orderkey, l_linenumber, 'min' AS rule FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_linenumber, 'max' FROM lineitem WHERE l_quantity > 30
 UNION ALL SELECT l_orderkey, l_linenumber, 'predicate' FROM lineitem WHERE l_quantity = 7)""")
def check_chain(t):
    amount = derive("amount", floating(), min=0.0, max=30.0)
    usual = derive("usual", amount, min=5.0, predicate=lambda c: c != 7)
    shown = derive("shown", usual, max=40.0)  # displays 40, enforces 30
    return bad(t.lineitem, LINE, l_quantity=shown).select(*LINE, "rule")


@query("SELECT count(*)::BIGINT AS conforming FROM nation")
def check_abstract(t):
    return modes.flag(t.nation, checks.column_rules(t.nation, n_name=abstract("top"))).agg(F.count_if("_valid").alias("conforming"))


@query("""SELECT event_id, 'map' AS whole, 'integer' AS k, CASE event_id % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'float' WHEN 2 THEN 'vector' WHEN 3 THEN 'string' ELSE 'null' END AS made FROM events""")
def check_dynamic_kind(t):
    made = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "1.0").when(F.col("event_id") % 5 == 2, F.concat(F.lit("["), "event_id", F.lit("]"))).when(F.col("event_id") % 5 == 3, '"7"').otherwise("null")
    return t.events.select("event_id", checks.dynamic_kind(F.col("props")).alias("whole"), checks.dynamic_kind(F.col("props"), "$.k").alias("k"), checks.dynamic_kind(made).alias("made"))


PARTS = {"scheme": r"^([a-z]+)://", "host": r"^[a-z]+://([^/?#]*)", "path": r"^[a-z]+://[^/?#]*([^?#]*)"}


def address(c):
    return {k: F.regexp_extract(c, p, 1) for k, p in PARTS.items()}


@query("""SELECT page_id, CASE WHEN regexp_extract(url, '^([a-z]+)://', 1) <> 'https' THEN 'scheme' ELSE 'host' END AS differs FROM pages
 WHERE regexp_extract(url, '^([a-z]+)://', 1) <> 'https' OR regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT LIKE 'm.%'""")
def check_location(t):
    a = address(F.col("url"))
    a["host"] = F.when(a["host"].startswith("m."), "m.").otherwise(a["host"])
    differs = location_violation(a, F.lit("web"), Location("web", {"scheme": "https", "host": "m."}))
    return t.pages.select("page_id", differs.alias("differs")).filter("differs is not null")


@query("SELECT page_id FROM pages WHERE NOT (url LIKE 'https://m.%' OR url LIKE 'http://th%')")
def check_location_predicate(t):
    """A location contract without fixed attributes but with a predicate over the whole address."""
    open_to = lambda a: labels.filter_paths(F.concat(a["scheme"], F.lit("://"), a["host"]), ("https://m.", "http://th"))
    differs = location_violation(address(F.col("url")), F.lit("web"), Location("web", {}), open_to)
    return t.pages.filter(differs == "predicate").select("page_id")


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS wrong FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) GROUP BY l_orderkey""")
def check_ref_kind(t):
    kinds = t.part.select(F.col("p_partkey").alias("ref"), F.when(F.col("p_size") > 10, "value").otherwise("action").alias("kind"))
    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    wrong = registry.wrong_kind(items, "l_orderkey", "refs", kinds, "ref", "kind", "value")
    return wrong.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("ref")).alias("wrong"))


@query("""SELECT page_id, p AS path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages) WHERE (p LIKE '/en/%' OR p LIKE '/fr/%') AND NOT (p LIKE '/en/6%')""", "filter_paths")
def filtered(t):
    df = t.pages.select("page_id", address(F.col("url"))["path"].alias("path"))
    return df.filter(labels.filter_paths(F.col("path"), ("/en/", "/fr/"), ("/en/6",)))


@query("SELECT o_orderkey, regexp_full_match(sha1(o_orderkey::VARCHAR), '[0-9a-f]{40}') AS ok, upper(sha1(o_orderkey::VARCHAR)) AS shown FROM orders")
def check_commit_hash(t):
    upper = F.upper(F.sha1(F.col("o_orderkey").cast("string")))
    return t.orders.select("o_orderkey", checks.full_match(F.lower(upper), "[0-9a-f]{40}").alias("ok"), upper.alias("shown"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 12 > 1")
def check_probability(t):
    p = floating(min=0.0, max=1.0)
    df = t.lineitem.select(*LINE, (F.col("l_discount") * 12).alias("p"))
    return modes.first_violation(df, checks.column_rules(df, p=p)).select(*LINE)


@query("SELECT p_partkey FROM part WHERE p_size & (p_size - 1) <> 0")
def check_power_of_two(t):
    power = derive("power", integer(min=1), predicate=lambda c: c.bitwiseAND(c - 1) == 0)
    return modes.first_violation(t.part, checks.column_rules(t.part, p_size=power)).select("p_partkey")


@query("SELECT doc_id FROM (SELECT d.doc_id, (l.quality = 1)::INT + (l.toxic = 1)::INT + (d.lang = 'en')::INT AS n FROM documents d JOIN labels l USING (doc_id)) WHERE n = 1")
def exactly_one_of(t):
    one = lambda c: F.when(c, 1)
    df = t.documents.join(t.labels, "doc_id").select("doc_id", one(F.col("quality") == 1).alias("good"), one(F.col("toxic") == 1).alias("toxic"), one(F.col("lang") == "en").alias("english"))
    contract = record(exactly_one=("good", "toxic", "english"))
    return modes.flag(df, checks.row_rules(df, contract)).filter("_valid").select("doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def apply_defaults(t):
    contract = record(field("doc_id", integer()), field("quality", integer(), default=-1), field("toxic", integer(), default=0))
    return canonical.with_defaults(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic"), contract)
