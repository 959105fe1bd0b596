"""Transitive closures over edge tables, with cycles reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.plans.scratch import discard, scope, small, written


def reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, depth): each node that a path leads to, once, with the length of a shortest path.

    A node that a cycle leads back to reaches itself. Without ``starts`` all pairs are
    found by doubling, so the rounds grow with the logarithm of the longest shortest
    path: a round joins the longest pairs it knows with those that go on from their ends,
    and writes the new ones only. With ``starts`` each round follows the edges of what was new in the last one.
    """
    e = edges.select("src", "dst").distinct()
    if starts is None:
        parts = [written(e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "reach")]
        span = 1
        while True:
            # all pairs up to ``span`` steps are known; a longer shortest path begins with one of just that length
            found = e.sparkSession.read.schema(parts[0].schema).parquet(*(p._scratch_path for p in parts))
            front = parts[-1].filter(F.col("depth") == span).select("start", F.col("node").alias("_via"), "depth")
            vias = written(front.select("_via").distinct(), "vias")
            if vias.isEmpty():
                discard(vias)
                return found
            on = found.select(F.col("start").alias("_via"), F.col("node"), F.col("depth").alias("_more")).join(small(vias), "_via", "left_semi")
            on = written(on, "onward")
            far = front.join(small(on), "_via").select("start", "node", (F.col("depth") + F.col("_more")).alias("depth"))
            # known pairs are no deeper than ``span``, what goes on from them is
            least = found.unionByName(far).groupBy("start", "node").agg(F.min("depth").alias("depth"))
            parts.append(written(least.filter(F.col("depth") > span), "reach"))
            discard(vias, on)
            span *= 2
    step = lambda at, name: at.join(e, F.col(name) == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
    front = written(step(starts.select("start").distinct(), "start").withColumn("depth", F.lit(1)), "frontier")
    found = written(front, "reach")
    depth = 1
    while not front.isEmpty():
        depth += 1
        new = step(front.select("start", "node"), "node").join(found, ["start", "node"], "left_anti")
        new = written(new.withColumn("depth", F.lit(depth)), "frontier")
        more = written(found.unionByName(new), "reach")
        discard(front, found)
        front, found = new, more
    discard(front)
    return found


def closure(edges: DataFrame, starts: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """(start, node, depth, path, cycle): every simple path from each start; there may be very many, ``reach`` gives each node once.

    ``edges`` is (src, dst). A path that comes back to one of its nodes is kept
    with ``cycle`` true and not followed. Each round joins the frontier with the
    edges and is written, so depth is limited by neither recursion nor lineage.
    Paths left after ``rounds`` rounds are an error.
    """
    e = edges.select("src", "dst").distinct()
    first = (starts or edges.select(F.col("src").alias("start")).distinct()).select("start")
    front = first.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth"), F.array("start", "dst").alias("path"), (F.col("start") == F.col("dst")).alias("cycle"))
    parts = []
    while True:
        front = written(front, "frontier")
        if front.isEmpty():
            break
        if len(parts) == rounds:
            raise RuntimeError(f"paths go on after {rounds} rounds")
        parts.append(front)
        on = front.filter("not cycle").join(e, F.col("node") == F.col("src"))
        front = on.select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cycle"))
    # the rounds lie in folders of one schema: one scan, whatever their number
    return edges.sparkSession.read.schema(front.schema).parquet(*(p._scratch_path for p in [*parts, front]))


def recursive_closure(spark: SparkSession, edges: DataFrame, start: str) -> DataFrame:
    """(start, node, depth, path, cycle) by a recursive query, for graphs within its limit of 100 levels."""
    edges.createOrReplaceTempView("_edges")
    return spark.sql(f"""
        WITH RECURSIVE r(start, node, depth, path, cycle) AS (
          SELECT src, dst, 1, array(src, dst), src = dst FROM _edges WHERE {start}
          UNION ALL
          SELECT r.start, e.dst, r.depth + 1, concat(r.path, array(e.dst)), array_contains(r.path, e.dst) FROM r JOIN _edges e ON r.node = e.src WHERE NOT r.cycle)
        SELECT * FROM r""")


def components_of(found: DataFrame) -> DataFrame:
    """(node, component) as ``components`` gives it, from a table of all pairs that ``reach`` found."""
    back = found.select(F.col("node").alias("start"), F.col("start").alias("node"))
    return found.select("start", "node").join(back, ["start", "node"]).groupBy(F.col("start").alias("node")).agg(F.min("node").alias("component"))


def cycles_of(found: DataFrame, members: DataFrame) -> DataFrame:
    """(component, length, cycle) as ``cycles`` gives it, from all pairs and their depths.

    A path is halved at a node that lies in its middle, again and again, so the rounds grow
    with the logarithm of the longest cycle.
    """
    to = lambda k: found.select(*(F.col(c).alias(f"_{c}{k}") for c in ("start", "node", "depth")))
    whole = members.select("component").distinct().join(to(0), (F.col("component") == F.col("_start0")) & (F.col("component") == F.col("_node0")))
    with scope() as kept:
        parts = written(whole.select("component", F.lit(0).alias("place"), F.col("component").alias("a"), F.col("component").alias("b"), F.col("_depth0").alias("length")), "paths")
        while not parts.filter("length > 1").isEmpty():
            half = F.ceil(F.col("length") / 2).cast("int")
            met = parts.filter("length > 1").withColumn("_h", half).join(to(1), (F.col("a") == F.col("_start1")) & (F.col("_h") == F.col("_depth1")))
            met = met.join(to(2), (F.col("_node1") == F.col("_start2")) & (F.col("b") == F.col("_node2")) & (F.col("length") - F.col("_h") == F.col("_depth2")))
            middle = written(met.groupBy("component", "place", "a", "b", "length", "_h").agg(F.min("_node1").alias("_m")), "middles")
            left = middle.select("component", "place", "a", F.col("_m").alias("b"), F.col("_h").alias("length"))
            right = middle.select("component", (F.col("place") + F.col("_h")).alias("place"), F.col("_m").alias("a"), "b", (F.col("length") - F.col("_h")).alias("length"))
            parts = written(parts.filter("length <= 1").unionByName(left).unionByName(right), "paths")
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("place", "a"))), lambda s: s["a"])
        out = parts.groupBy("component").agg(F.count("*").cast("int").alias("length"), nodes.alias("_nodes"))
        out = written(out.select("component", "length", F.concat("_nodes", F.array("component")).alias("cycle")), "cycles")
        kept.append(out)
    return out


# --- cycles --------------------------------------------------------------------------------------------------

#: Edges up to which Spark may broadcast a side of the joins in a loop. All that is broadcast
#: passes through the driver, once for each join of each round, and the size of a compressed
#: file tells little of its rows.
LOOP_ROWS = 1 << 16


def _dealt(rows: int):
    """What marks a side of a loop's joins: beyond ``LOOP_ROWS`` both sides are shuffled."""
    return (lambda df: df.hint("merge")) if rows > LOOP_ROWS else (lambda df: df)


def _trimmed(edges: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """Edges whose ends are both entered and left, and their number; chains that lead to or from a cycle shrink by one a round."""
    size = edges.count()
    for _ in range(rounds if size else 0):
        deal = _dealt(size)
        left = edges.join(deal(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(deal(edges.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        left = written(left.select("src", "dst"), "trimmed")
        discard(edges)
        edges, before, size = left, size, left.count()
        if size in (0, before):
            break
    return edges, size


def _spread(values: DataFrame, edges: DataFrame, deal) -> DataFrame:
    """(node, color): the least color of all nodes from which a path leads to each node, its own among them. Only what fell is passed on."""
    known, front = values, values
    while True:
        sent = front.join(deal(edges), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("_new"))
        both = known.join(deal(sent), "node", "left").select("node", F.least("color", "_new").alias("color"), (F.col("_new") < F.col("color")).alias("_fell"))
        both = written(both, "colors")
        front = both.filter("_fell").select("node", "color")
        known = both.select("node", "color")
        if front.isEmpty():
            return known


def components(edges: DataFrame, trim_rounds: int = 8) -> DataFrame:
    """(node, component): the nodes that stand on a cycle, with the least node of their strongly connected component.

    What can't be on a cycle is trimmed. Each node takes the least node that leads to it as
    its pivot; from all pivots at once paths are followed backward, within the nodes of
    one pivot, and what is met is the pivot's component. Edges within other nodes of one
    pivot are split off and searched anew. All components of a round are found together,
    and rounds pass on only what changed; nothing is listed path by path.
    """
    spark = edges.sparkSession
    left = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    schema, parts = left.select(F.col("src").alias("node"), F.col("src").alias("component")).schema, []
    with scope() as kept:
        while True:
            left, size = _trimmed(left, trim_rounds)
            if not size:
                break
            deal = _dealt(size)
            nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
            colors = _spread(written(nodes.withColumn("color", F.col("node")), "nodes"), left, deal)
            of = lambda name, to: deal(colors.select(F.col("node").alias(name), F.col("color").alias(to)))
            within = written(left.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").filter("_a = _b").select("src", "dst", F.col("_a").alias("color")), "within")
            # backward from the pivots
            found = front = written(colors.filter("node = color"), "members")
            while True:
                before = front.join(deal(within.select("src", "dst")), F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "color").distinct()
                front = written(before.join(deal(found.select("node")), "node", "left_anti"), "members")
                if front.isEmpty():
                    break
                found = written(found.unionByName(front), "found")
            end = lambda name: deal(found.select(F.col("node").alias(name)))
            inner = within.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi")
            cyclic = written(inner.select(F.col("src").alias("node"), F.col("color").alias("component")).distinct(), "component")
            parts.append(cyclic)
            kept.append(cyclic)
            left = written(within.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti").select("src", "dst"), "edges")
    return spark.read.schema(schema).parquet(*(p._scratch_path for p in parts)) if parts else spark.createDataFrame([], schema)


def cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, length, cycle): a shortest cycle through the least node of each component of ``members``, closed by that node again.

    A breadth-first search in all components at once; each node keeps the least of the
    nodes that lead to it by a shortest path, and the cycle is read back from these.
    """
    deal = _dealt(members.count())
    e = edges.select("src", "dst").distinct()
    e = e.join(deal(members.select(F.col("node").alias("src"), "component")), "src").join(deal(members.select(F.col("node").alias("dst"), F.col("component").alias("_c"))), "dst").filter("component = _c").select("component", "src", "dst")
    with scope() as kept:
        e = written(e, "inner")
        deal = _dealt(e.count())
        front = written(e.filter("src = component").groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("parent")).withColumn("depth", F.lit(1)), "front")
        parts = [front]
        while True:
            closed = front.filter("node = component").select("component")
            seen = front.sparkSession.read.schema(front.schema).parquet(*(p._scratch_path for p in parts))
            done = seen.filter("node = component").select("component").distinct()
            far = front.join(deal(closed), "component", "left_anti").join(deal(e), (F.col("node") == F.col("src")) & (front["component"] == e["component"])).select(e["component"], F.col("dst").alias("node"), F.col("src").alias("parent"))
            new = far.join(deal(done), "component", "left_anti").groupBy("component", "node").agg(F.min("parent").alias("parent")).join(deal(seen.select("component", "node")), ["component", "node"], "left_anti")
            front = written(new.withColumn("depth", F.lit(len(parts) + 1)), "front")
            if front.isEmpty():
                break
            parts.append(front)
        # back from the end, one step a round
        tree = front.sparkSession.read.schema(front.schema).parquet(*(p._scratch_path for p in parts))
        walk = written(tree.filter("node = component").select("component", F.col("depth").alias("length"), F.col("parent").alias("at"), F.array("node").alias("cycle")), "walk")
        back = deal(tree.select(F.col("component").alias("_c"), F.col("node").alias("_n"), F.col("parent").alias("_p")))
        for _ in range(len(parts) - 1):
            on = walk.join(back, (F.col("component") == F.col("_c")) & (F.col("at") == F.col("_n")) & (F.col("at") != F.col("component")), "left")
            going = F.col("_p").isNotNull()
            walk = written(on.select("component", "length", F.when(going, F.col("_p")).otherwise(F.col("at")).alias("at"), F.when(going, F.concat(F.array("at"), "cycle")).otherwise(F.col("cycle")).alias("cycle")), "walk")
        out = written(walk.select("component", "length", F.concat(F.array("component"), "cycle").alias("cycle")), "cycles")
        kept.append(out)
    return out
