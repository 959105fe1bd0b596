"""Mixing sources to target weights by hash-threshold histograms.

Native DataFrame code. A document's size is its number of words. Sources share
the corpus size by weight, none above ``max_repeat`` times its own size; what a
capped source leaves is shared again among the others.

A source whose target is k whole passes and a rest takes every document k times
and, for the rest, the documents whose hash lies below a threshold. Sizes are
summed by source and hash bucket; running sums over the buckets find the bucket
in which the rest ends, a second histogram of that bucket alone refines the
threshold, and documents are filtered by comparing hashes. Nothing is sorted but
the bounded histograms. The hash depends on the doc_id alone, on the text where the
id is null: reruns agree, and a larger budget takes a superset. Where a hash is shared at
the threshold, its rows are taken by id, size and text hash while they fit; of rows
that are equal in these, which are interchangeable, as many as fit. So what is taken
is never further from the target than half a document.

Sources are a dimension of the mix, one row each; only that table, never documents,
is ranked in one task. Null and empty texts have size 0 and are taken by their hash
like others; a text of any length counts whole. A null source is a source of its own,
last in order. Repeated rows are taken alike, but where the rest ends among them. An empty table gives an empty result;
other columns, whatever their names, are carried by ``mixed`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.rowkeys import TEXT_HASH, text_hash, words
from pactum.plans.scratch import small, written

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)

#: Buckets of each of the two histograms; the threshold is refined to 1 / BUCKETS ** 2 of the hash range.
BUCKETS = 1024


def hash_slot(doc_id: Column, text: Column) -> Column:
    """A number in [0, BUCKETS ** 2), from MD5 of the id as text; of the text itself where the id is null."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 5)
    return F.conv(head, 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target for a table (source, source_size), one row for each source.

    The capped sources are those with the least size for their weight, so a
    running sum in that order finds the level at which the rest share.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the first source in order that its share at this level fits
    w = w.withColumn("_fit", F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(order).alias("r"), F.col("_level").alias("level"))))
    w = w.withColumn("_level", F.min("_fit").over(every)["level"])
    return w.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("_level") * F.col("weight")), F.col("cap")).alias("target"))


def _threshold(histogram: DataFrame, bucket: str, goal: str) -> DataFrame:
    """Per source: the last bucket that starts below the goal, and the size before it."""
    w = Window.partitionBy("_s").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    run = histogram.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return run.filter(F.col("_before") < F.col(goal)).groupBy("_s").agg(F.max(F.struct(bucket, "_before", "_size")).alias("_cut"))


def _places(rows: DataFrame) -> DataFrame:
    """_s, _limit: the ``_place`` before which ``_m`` rows of each ``_s`` stand, fewer than there are.

    Places are written ``monotonically_increasing_id``s: rows are counted by the task
    that wrote them, and only those of one such task are put in order.
    """
    part = F.shiftright("_place", 33)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_s", "_m", part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", before).filter((F.col("_before") <= F.col("_m")) & (F.col("_m") < F.col("_before") + F.col("_n")))
    parts = small(written(parts.select(F.col("_s").alias("_ps"), "_part", "_before"), "parts"))
    at = F.row_number().over(Window.partitionBy("_s").orderBy("_place")) - 1
    inside = rows.join(parts, (F.col("_s") == F.col("_ps")) & (part == F.col("_part"))).withColumn("_at", at + F.col("_before"))
    return inside.filter(F.col("_at") == F.col("_m")).select("_s", F.col("_place").alias("_limit"))


def _row_key(place: Column) -> Column:
    """The order of rows of one source and slot."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("size").alias("size"), F.col(TEXT_HASH).alias("hash"), place.alias("place"))


def _slot_ends(edge: DataFrame) -> DataFrame:
    """_ks, _key: per source the key of the first row of its last slot that is not taken; no row where all are.

    ``edge`` holds the rows of those slots, with what is left to take as ``_open``.
    Rows equal but for their place are counted before they are put in order.
    """
    groups = edge.groupBy("_s", "_open", "doc_id", "size", TEXT_HASH).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s").orderBy(F.col("doc_id").asc_nulls_last(), "size", TEXT_HASH).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_open") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(w), F.lit(0))
    # a row is taken if the target is nearer with it
    fit = F.when(F.col("size") > 0, F.floor((2 * F.col("_room") - F.col("size")) / (2 * F.col("size"))) + 1).otherwise(F.col("_n"))
    fit = F.when(F.col("_room") > 0, F.greatest(F.lit(0), F.least("_n", fit))).otherwise(0).cast("long")
    groups = groups.withColumn("_room", room).withColumn("_m", fit).filter("_m < _n")
    first = groups.groupBy("_s").agg(F.min_by(F.struct("doc_id", "size", TEXT_HASH, "_m"), _row_key(F.lit(0))).alias("_f")).select("_s", "_f.*")
    first = written(first, "slot-ends")
    split = first.filter("_m > 0").select(F.col("_s").alias("_fs"), F.col("doc_id").alias("_fid"), F.col("size").alias("_fsize"), F.col(TEXT_HASH).alias("_fhash"), "_m")
    if split.isEmpty():
        return first.select(F.col("_s").alias("_ks"), _row_key(F.lit(0).cast("long")).alias("_key"))
    same = (F.col("_s") == F.col("_fs")) & F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("size") == F.col("_fsize")) & (F.col(TEXT_HASH) == F.col("_fhash"))
    limits = _places(written(edge.join(F.broadcast(split), same).select("_s", "_m", "_place"), "equal-rows"))
    return first.join(limits, "_s", "left").select(F.col("_s").alias("_ks"), _row_key(F.coalesce("_limit", F.lit(0).cast("long"))).alias("_key"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, and the text hash, for each row of ``docs``."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), hash_slot(F.col("doc_id"), F.col("text")).alias("_slot"), text_hash(F.col("text")).alias(TEXT_HASH), F.monotonically_increasing_id().alias("_place"))
    sized = written(sized, "sizes")
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # one row for each source; a number stands for it from here on
    goals = targets(sizes, weights, max_repeat).withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = goals.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    goals = written(goals, "goals")
    named = sized.join(small(goals.select(F.col("source").alias("_source"), "_s", "_whole", "_rest")), F.col("source").eqNullSafe(F.col("_source")))
    coarse = named.groupBy("_s", "_rest", F.floor(F.col("_slot") / BUCKETS).cast("int").alias("_b")).agg(F.sum("size").alias("_size"))
    cut = written(_threshold(coarse, "_b", "_rest").select(F.col("_s").alias("_cs"), F.col("_cut._b").alias("_cb"), F.col("_cut._before").alias("_cbefore")), "cut")
    edge = named.join(small(cut), (F.col("_s") == F.col("_cs")) & (F.floor(F.col("_slot") / BUCKETS) == F.col("_cb")))
    fine = edge.groupBy("_s", "_cbefore", "_rest", "_slot").agg(F.sum("size").alias("_size")).withColumn("_left", F.col("_rest") - F.col("_cbefore"))
    ends = _threshold(fine.select("_s", "_slot", "_size", "_left"), "_slot", "_left").join(fine.groupBy("_s").agg(F.min("_left").alias("_left")), "_s")
    ends = written(ends.select(F.col("_s").alias("_es"), F.col("_cut._slot").alias("_end"), (F.col("_left") - F.col("_cut._before")).alias("_open")), "ends")
    keys = _slot_ends(named.join(small(ends), (F.col("_s") == F.col("_es")) & (F.col("_slot") == F.col("_end"))))
    goal = goals.join(ends, F.col("_s") == F.col("_es"), "left").join(keys, F.col("_s") == F.col("_ks"), "left")
    goal = goal.select(F.col("source").alias("_source"), "source_size", "target", "_whole", F.coalesce("_end", F.lit(-1)).alias("_end"), "_key")
    out = sized.join(small(written(goal, "goal")), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("_whole") + F.when((F.col("_slot") < F.col("_end")) | ((F.col("_slot") == F.col("_end")) & (F.col("_key").isNull() | (_row_key(F.col("_place")) < F.col("_key")))), 1).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), TEXT_HASH)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it."""
    key = ("doc_id", "source", TEXT_HASH)
    taken = mix(docs, **settings).groupBy(*key).agg(F.max("copies").alias("_copies"), F.min("copies").alias("_least"), F.count("*").alias("_rows"), F.sum("copies").alias("_total"))
    taken = written(taken.filter("_copies > 0"), "taken")
    of = lambda t, *more: small(t.select(F.col("doc_id").alias("_k_id"), F.col("source").alias("_k_source"), F.col(TEXT_HASH).alias("_k_hash"), *more))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_k_id")) & F.col("_row.source").eqNullSafe(F.col("_k_source")) & (text_hash(F.col("_row.text")) == F.col("_k_hash"))
    rows = docs.select(F.struct("*").alias("_row"))
    out = rows.join(of(taken.filter("_least = _copies"), "_copies"), same).select("_row", "_copies")
    # one group of equal rows for each source at most: some are taken once more than the others
    split = written(taken.filter("_least < _copies").withColumn("_s", F.xxhash64(*key)), "split")
    if not split.isEmpty():
        more = of(split, "_copies", "_least", "_s", (F.col("_total") - F.col("_least") * F.col("_rows")).alias("_m"))
        equal = written(rows.join(more, same).select("_row", "_copies", "_least", "_s", "_m", F.monotonically_increasing_id().alias("_place")), "equal-rows")
        limits = small(written(_places(equal).select(F.col("_s").alias("_ls"), "_limit"), "limits"))
        again = equal.join(limits, F.col("_s") == F.col("_ls")).select("_row", F.when(F.col("_place") < F.col("_limit"), F.col("_copies")).otherwise(F.col("_least")).alias("_copies"))
        out = out.unionByName(again.filter("_copies > 0"))
    return out.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 5))::INT AS slot FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level,
 row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, r) AS level FROM l WHERE level * weight <= cap),
g AS (SELECT source, source_size, coalesce(least(cap, v.level * weight), cap) AS target FROM l, v),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM g),
g3 AS (SELECT *, target - whole * source_size AS rest FROM g2),
c AS (SELECT d.*, g3.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY slot, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM d JOIN g3 ON d.source IS NOT DISTINCT FROM g3.source),
m AS (SELECT *, whole + CASE WHEN before < rest AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source, source_size, target, copies, (size * copies)::BIGINT AS taken FROM m
"""
