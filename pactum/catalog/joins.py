"""Lookups, references, versions, closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.operators import closure, labels, refs, registry
from pactum.plans.scratch import small, written


@query("""SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 'no ' || (c_nationkey + 3) || '; available: ' || (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT n_nationkey::VARCHAR AS k FROM nation)) END AS error
 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3""")
def lookup_by_name(t):
    df = t.customer.select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, ":").otherwise(""), F.col("c_nationkey") + 3).alias("label"))
    reg = t.nation.select(F.lit("value").alias("kind"), F.col("n_nationkey").cast("string").alias("name"), "n_name")
    return registry.lookup_by_name(df, "label", reg, "name", "value").select("c_custkey", "n_name", "error")


def order_refs(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("refs"))


@query("SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS resolved FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def resolve_references(t):
    return registry.resolve_references(order_refs(t), "l_orderkey", "refs", t.part, "p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unresolved_references(t):
    return registry.unresolved(t.lineitem, "l_partkey", t.part.filter("p_size > 10"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT 'order:' || l_orderkey AS source, 'input' AS role, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS position, l_partkey AS target FROM lineitem
 UNION ALL SELECT 'order:' || o_orderkey, 'output', 0, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def lineage_edges(t):
    df = order_refs(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("outs", F.array("o_custkey"))
    return registry.lineage_edges(df, F.concat(F.lit("order:"), "o_orderkey"), input="refs", output="outs")


@query("""SELECT event_id, CASE WHEN hi IS NULL THEN 'unknown_type' WHEN value < lo THEN 'min' ELSE 'max' END AS rule FROM events LEFT JOIN (
 SELECT event_type AS et, 10.0 AS lo, 10.0 * length(event_type) AS hi FROM events WHERE event_type <> 'click' GROUP BY event_type) ON et = event_type WHERE hi IS NULL OR value < lo OR value > hi""")
def validate_by_type_name(t):
    limits = t.events.filter("event_type <> 'click'").groupBy(F.col("event_type").alias("type_name")).agg(F.lit(10.0).alias("min")).withColumn("max", 10.0 * F.length("type_name"))
    return registry.validate_by_type_name(t.events, "event_type", "value", limits).select("event_id", "rule")


def order_refs_listing(t):
    """Branches, plain tags, peeled tags, and names that both have."""
    k = F.col("o_orderkey")
    sha = lambda salt: F.sha1(F.concat(F.lit(salt), k))
    o = t.orders
    return (
        o.filter(k % 4 < 2).select(sha("b").alias("sha"), F.concat(F.lit("refs/heads/v"), k).alias("ref"))
        .unionByName(o.filter((k % 4 == 1) | (k % 4 == 2)).select(sha("t").alias("sha"), F.concat(F.lit("refs/tags/v"), k).alias("ref")))
        .unionByName(o.filter((k % 4 == 2) & (k % 8 == 2)).select(sha("p").alias("sha"), F.concat(F.lit("refs/tags/v"), k, F.lit("^{}")).alias("ref")))
    )


_REFS = """refs AS (SELECT sha1('b' || o_orderkey) AS sha, 'refs/heads/v' || o_orderkey AS ref FROM orders WHERE o_orderkey % 4 < 2
 UNION ALL SELECT sha1('t' || o_orderkey), 'refs/tags/v' || o_orderkey FROM orders WHERE o_orderkey % 4 IN (1, 2)
 UNION ALL SELECT sha1('p' || o_orderkey), 'refs/tags/v' || o_orderkey || '^{}' FROM orders WHERE o_orderkey % 8 = 2)"""
_WANT = """wants AS (SELECT DISTINCT CASE o_orderkey % 7 WHEN 0 THEN substr(sha1('b' || o_orderkey), 1, 12) WHEN 1 THEN substr(sha1('t' || o_orderkey), 1, 3)
 WHEN 2 THEN 'local' || o_orderkey WHEN 3 THEN 'none' || o_orderkey WHEN 4 THEN substr(sha1('b' || o_orderkey), 1, 4) ELSE 'v' || o_orderkey END AS want FROM orders)"""
_NAMED = """named AS (SELECT w.want, max(CASE WHEN r.ref = 'refs/heads/' || w.want THEN sha END) AS branch,
 coalesce(max(CASE WHEN r.ref = 'refs/tags/' || w.want || '^{}' THEN sha END), max(CASE WHEN r.ref = 'refs/tags/' || w.want THEN sha END)) AS tag
 FROM wants w JOIN refs r ON r.ref IN ('refs/heads/' || w.want, 'refs/tags/' || w.want, 'refs/tags/' || w.want || '^{}') GROUP BY w.want)"""
_PREFIX = """pre AS (SELECT want, count(DISTINCT sha)::BIGINT AS n_ids, list(DISTINCT sha ORDER BY sha) AS ids FROM wants JOIN (
 SELECT sha, unnest([substr(sha, 1, 3), substr(sha, 1, 4), substr(sha, 1, 12)]) AS p FROM refs) ON p = want GROUP BY want)"""


def wanted(t):
    k = F.col("o_orderkey")
    sha = lambda salt, n: F.substring(F.sha1(F.concat(F.lit(salt), k)), 1, n)
    m = k % 7
    want = F.when(m == 0, sha("b", 12)).when(m == 1, sha("t", 3)).when(m == 2, F.concat(F.lit("local"), k)).when(m == 3, F.concat(F.lit("none"), k)).when(m == 4, sha("b", 4)).otherwise(F.concat(F.lit("v"), k))
    return t.orders.select(want.alias("want"))


@query(f"WITH {_REFS}, {_WANT}, {_NAMED} SELECT want, branch, tag FROM named")
def resolve_ref_exact(t):
    return refs.exact_matches(wanted(t), order_refs_listing(t))


@query(f"WITH {_REFS}, {_WANT}, {_PREFIX} SELECT want, unnest(ids) AS sha FROM pre")
def resolve_ref_prefix(t):
    return refs.prefix_matches(wanted(t), order_refs_listing(t))


_RESOLVED = """res AS (SELECT want, CASE WHEN branch IS NOT NULL AND tag IS NOT NULL THEN 'collision' WHEN branch IS NOT NULL THEN 'branch' WHEN tag IS NOT NULL THEN 'tag' WHEN n_ids = 1 THEN 'prefix'
 WHEN n_ids > 1 THEN 'ambiguous' WHEN want LIKE 'local%' THEN 'local' ELSE 'unknown' END AS status, branch, tag, ids FROM wants LEFT JOIN named USING (want) LEFT JOIN pre USING (want)),
 done AS (SELECT want, status, CASE WHEN status IN ('branch', 'tag') THEN coalesce(branch, tag) WHEN status = 'prefix' THEN ids[1] WHEN status = 'local' THEN sha1(want) END AS sha, CASE WHEN status = 'ambiguous' THEN ids END AS candidates FROM res)"""


def local_refs(t):
    return wanted(t).filter(F.col("want").startswith("local")).select("want", F.sha1("want").alias("sha"))


@query(f"""WITH {_REFS}, {_WANT}, {_NAMED}, {_PREFIX}, {_RESOLVED} SELECT want, status, sha, len(candidates)::BIGINT AS n_candidates, NULL AS candidate FROM done
 UNION ALL SELECT want, 'candidate', NULL, NULL, unnest(candidates) FROM done WHERE status = 'ambiguous'""")
def resolve_ref(t):
    """A row for each request, and one for each candidate of an ambiguous one."""
    listing = written(order_refs_listing(t), "listing")
    matches = written(refs.prefix_matches(wanted(t), listing), "matches")
    resolved = written(refs.resolve_refs(wanted(t), listing, local_refs(t), matches=matches), "resolved")
    listed = refs.candidates(resolved, listing, matches=matches).select("want", F.lit("candidate").alias("status"), F.col("sha").alias("candidate"))
    return resolved.unionByName(listed, allowMissingColumns=True)


@query("""SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'miss' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'corrupt' ELSE 'hit' END AS status FROM customer""")
def snapshot_status(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return refs.snapshot_status(t.customer, "c_custkey", o, o.filter("o_orderstatus = 'P'"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'no such root' WHEN 2 THEN 'no such target' WHEN 3 THEN 'no such field' ELSE 'empty label' END AS status,
 CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END END AS value FROM part""")
def resolve_targets(t):
    k = F.col("p_partkey")
    root = F.concat(F.lit("r"), k % 3)
    label = F.when(k % 5 == 0, F.concat(F.lit("@"), root, F.lit("//any/pkg:p"), k, F.when(k % 2 == 0, ".a.brand").otherwise("")))
    label = label.when(k % 5 == 1, F.concat(F.lit("@zz//p:p"), k)).when(k % 5 == 2, F.concat(F.lit("@"), root, F.lit("//p:q"), k)).when(k % 5 == 3, F.concat(F.lit("@"), root, F.lit("//p:p"), k, F.lit(".nothing"))).otherwise("")
    target = F.concat(F.lit("p"), k)
    leaves = t.part.select(root.alias("root"), target.alias("target"), F.lit("").alias("path"), F.col("p_name").alias("value")).unionByName(t.part.select(root.alias("root"), target.alias("target"), F.lit("a.brand").alias("path"), F.col("p_brand").alias("value")))
    roots = t.part.select(root.alias("name")).distinct()
    return labels.resolve_targets(t.part.select("p_partkey", label.alias("label")), "label", roots, leaves).drop("label")


@query(f"""WITH {_REFS}, {_WANT}, {_NAMED}, {_PREFIX}, {_RESOLVED}
SELECT want || '|//p:t' AS label, sha AS workspace, CASE WHEN sha IS NULL THEN NULL WHEN substr(sha, 1, 1) IN ('0', '1', '2', '3') THEN 'miss' WHEN substr(sha, 1, 1) IN ('4', '5', '6', '7') THEN 'corrupt' ELSE 'hit' END AS snapshot, status FROM done
UNION ALL SELECT '//p:t', NULL, NULL, 'unversioned'""")
def workspace_for_label(t):
    asked = wanted(t).distinct().select(F.concat("want", F.lit("|//p:t")).alias("label"))
    plain = t.region.limit(1).select(F.lit("//p:t").alias("label"))
    # parsed once: a long expression that every use would repeat
    df = written(asked.unionByName(plain).withColumn("want", labels.parse_label(F.col("label"))["ref"]), "labels")
    # read four times below
    found = written(refs.resolve_refs(df.filter("want is not null"), written(order_refs_listing(t), "listing"), local_refs(t)), "resolved")
    ids = found.filter("sha is not null").select("sha")
    state = refs.snapshot_status(ids.distinct(), "sha", ids.filter("substr(sha, 1, 1) >= '4'"), ids.filter("substr(sha, 1, 1) >= '8'"))
    j = df.join(found, "want", "left").join(state.withColumnRenamed("status", "snapshot"), "sha", "left")
    return j.select("label", F.col("sha").alias("workspace"), "snapshot", F.coalesce("status", F.lit("unversioned")).alias("status"))


def supply_edges(t):
    """Each supplier loads two others; every twentieth chain returns to its start."""
    k = F.col("s_suppkey")
    n = t.supplier.count()
    back = t.supplier.filter(k % 20 == 19).select(k.alias("src"), (k - 19).alias("dst"))
    return t.supplier.filter((k % 20 != 19) & (k + 1 <= n)).select(k.alias("src"), (k + 1).alias("dst")).unionByName(back.filter("src % 40 = 39"))


_EDGES = """edges AS (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier WHERE s_suppkey % 20 <> 19 AND s_suppkey + 1 <= (SELECT count(*) FROM supplier)
 UNION ALL SELECT s_suppkey, s_suppkey - 19 FROM supplier WHERE s_suppkey % 20 = 19 AND s_suppkey % 40 = 39)"""
_REACH = """r(start, node, depth, path, cycle) AS (SELECT src, dst, 1, [src, dst], src = dst FROM edges
 UNION ALL SELECT r.start, e.dst, r.depth + 1, list_append(r.path, e.dst), list_contains(r.path, e.dst) FROM r JOIN edges e ON r.node = e.src WHERE NOT r.cycle)"""


@query(f"""WITH RECURSIVE {_EDGES}, {_REACH}, back AS (SELECT start, path, min(start) OVER (PARTITION BY list_sort(list_distinct(path))) AS component FROM r WHERE start = node)
 SELECT r.start, r.node, min(depth)::INT AS depth, r.start = r.node AS cycle, any_value(b.component) AS component, any_value(p.path) AS cycle_path
 FROM r LEFT JOIN back b ON b.start = r.start LEFT JOIN back p ON p.start = b.component GROUP BY r.start, r.node""")
def import_closure(t):
    """What each supplier loads, directly or not, once each; one that loads itself stands on a cycle, which is given."""
    found = closure.reach(supply_edges(t))
    members = written(closure.components_of(found), "members")
    loops = closure.cycles_of(found, members).select("component", F.col("cycle").alias("cycle_path"))
    named = members.join(loops, "component", "left").withColumnRenamed("node", "start")
    return found.withColumn("cycle", F.col("start") == F.col("node")).join(named, "start", "left")


def part_edges(t):
    """Each part loads the one that its key leads to by a linear step within its block of 40, so chains end in cycles."""
    k = F.col("p_partkey")
    return t.part.select(k.alias("src"), (F.floor(k / 40) * 40 + (k % 40 * 7 + 3) % 37).cast("long").alias("dst")).join(t.part.select(k.alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")


@query("""WITH RECURSIVE edges AS (SELECT p_partkey AS src, p_partkey // 40 * 40 + (p_partkey % 40 * 7 + 3) % 37 AS dst FROM part WHERE p_partkey // 40 * 40 + (p_partkey % 40 * 7 + 3) % 37 IN (SELECT p_partkey FROM part)),
r(start, node, path) AS (SELECT src, dst, [src, dst] FROM edges UNION ALL SELECT start, dst, list_append(path, dst) FROM r JOIN edges ON node = src WHERE node <> start AND NOT list_contains(path[2:], dst)),
c AS (SELECT start AS node, path, min(start) OVER (PARTITION BY list_sort(list_distinct(path))) AS component FROM r WHERE node = start)
SELECT c.node, c.component, (len(l.path) - 1)::INT AS length, l.path AS cycle FROM c JOIN c l ON l.node = c.component""")
def import_cycles(t):
    """Parts that stand on a cycle of loads, with their component and one shortest cycle of it."""
    edges = written(part_edges(t), "loads")
    members = written(closure.components(edges), "members")
    return members.join(small(closure.cycles(edges, members)), "component").select("node", "component", "length", "cycle")


@query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT start, node, depth, path, cycle FROM r")
def import_paths(t):
    """Every chain of loads from each supplier, with its path."""
    return closure.closure(supply_edges(t))


@query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT node AS changed, start AS affected, min(depth)::INT AS depth FROM r GROUP BY node, start")
def impact_closure(t):
    """Whom a change reaches, each once and with the length of a shortest chain; on a cycle a supplier reaches itself."""
    back = supply_edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure.reach(back).select(F.col("start").alias("changed"), F.col("node").alias("affected"), "depth")


def type_table(t):
    """Each part is a type whose base is the part of half its key; bounds from its size and price."""
    k = F.col("p_partkey")
    return t.part.select(k.alias("type"), F.when(k >= 2, F.floor(k / 2)).alias("base"), F.col("p_size").alias("min"), F.when(k % 3 != 0, F.floor("p_retailprice")).alias("max"))


_TYPES = "types AS (SELECT p_partkey AS type, CASE WHEN p_partkey >= 2 THEN p_partkey // 2 END AS base, p_size AS min, CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice)::BIGINT END AS max FROM part)"
_UP = """up(type, ancestor, depth) AS (SELECT type, type, 0 FROM types
 UNION ALL SELECT up.type, t.base, up.depth + 1 FROM up JOIN types t ON t.type = up.ancestor WHERE t.base IS NOT NULL)"""


def ancestry(t):
    types = type_table(t)
    found = closure.reach(types.filter("base is not null").select(F.col("type").alias("src"), F.col("base").alias("dst")))
    up = found.select(F.col("start").alias("type"), F.col("node").alias("ancestor"), "depth")
    return up.unionByName(types.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("depth")))


@query(f"WITH RECURSIVE {_TYPES}, {_UP} SELECT type, ancestor, depth FROM up")
def inheritance_closure(t):
    return ancestry(t)


@query(f"WITH RECURSIVE {_TYPES}, {_UP} SELECT up.type, max(types.min) AS min, min(types.max) AS max FROM up JOIN types ON types.type = ancestor GROUP BY up.type")
def effective_bounds(t):
    return registry.effective_bounds(ancestry(t), type_table(t))


@query(f"WITH RECURSIVE {_TYPES}, {_UP} SELECT up.type, 'max' AS attr, arg_min(types.max, depth) AS value FROM up JOIN types ON types.type = ancestor WHERE types.max IS NOT NULL GROUP BY up.type")
def nearest_attribute(t):
    attrs = type_table(t).filter("max is not null").select("type", F.lit("max").alias("attr"), F.col("max").alias("value"))
    return registry.nearest_attribute(ancestry(t), attrs)


@query("""SELECT p_orderkey AS o_orderkey, ok AS compatible FROM (SELECT o.o_orderkey AS p_orderkey, (o.o_orderkey % 3 = 0 OR o.o_orderpriority = '1-URGENT') AND o.o_orderstatus = 'F' AS ok FROM orders o)""")
def location_compat(t):
    from pactum.sources.values import location_compatible

    k = F.col("o_orderkey")
    want = t.orders.select(k, F.when(k % 3 != 0, "1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"))
    return location_compatible(t.orders, want, ["o_orderkey"], ["o_orderpriority", "o_orderstatus"])
