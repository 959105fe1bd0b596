"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document's set holds its distinct word shingles (words lower-cased A-Z). Two
documents are linked when 100 * intersection >= percent * union. Equal sets form
one class; only one document of each class is compared further.

1. ``BANDS`` bands of ``ROWS`` MinHash values give band keys. A pair at the
   threshold shares no key with chance (1 - 0.8**ROWS)**BANDS, below 4e-6.
2. The MinHash samples are folded into an odd sketch: a bitmap that holds the
   parity of the samples hashed to each bit. The bits in which two sketches
   differ estimate the similarity, most precisely where it is high, and rule out
   pairs far below the threshold.
3. Each document meets the smallest document, the pivot, of each of its buckets. The
   star of each document's best pair is confirmed on full sets first; then other pairs
   whose ends are still in different components.
4. Members of one pivot that are still in different components may be linked although
   both differ from the pivot. They are compared by how they differ from it: for sets
   x and y with differences dx and dy from the pivot, x and y differ in
   |dx| + |dy| - 2 |dx & dy| shingles, so a link needs a stated number of common
   shingles in dx and dy. What a hot group shares is in no difference. An exact prefix
   join finds the pairs: shingles of a difference are ordered by how many members
   have them, and pairs meet only at a shingle after which enough others are left. Such
   a shingle allows a member partners whose need lies in an interval: a run of rows in
   the order of needs. One sort finds the runs and a join by blocks of places makes only
   these, so rows grow with members and meetings, not with their square. If no common shingle is needed, both are linked with the
   member of least need at once. All other pairs that meet are confirmed on full sets.

No group is gathered whole: members meet by joins whose hot keys adaptive
execution splits, and components are found by joins.

Null or empty texts have an empty set and are linked with nothing. Null doc_ids
count as larger than all; a set that only rows of null doc_id have is compared no
further and has a null component_id. Repeated rows are equal sets. A doc_id with
several texts is linked with what any of them is linked with. A text of any length is
shingled whole; its set is a value of one row. Ties of candidates go to the smaller
doc_id, as does the name of a component. An empty table gives an empty result. Other
columns, whatever their names, are carried by ``deduplicated`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm import textbytes
from pactum.llm.rowkeys import TEXT_HASH, only_rows, text_hash
from pactum.plans.components import components
from pactum.plans.scratch import discard, scope, small, written

# Fixed parameters of the comparison.
BANDS, ROWS = 32, 5
SKETCH_BITS = 1024
#: Pairs whose sketches estimate less than the threshold minus this are not confirmed (over 6 standard deviations).
MARGIN = 0.25

_A = textbytes.random_words(BANDS * ROWS, 101) | np.uint64(1)
_B = textbytes.random_words(BANDS * ROWS, 202)
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``size`` make one shingle."""
    h, owner = textbytes.word_hashes(texts)
    bounds = textbytes.groups(owner, len(texts))
    with np.errstate(over="ignore"):
        rolled = h.copy() * _ONE
        for k in range(1, size):
            rolled[: len(h) - k] = textbytes.splitmix(rolled[: len(h) - k]) * _ONE + h[k:] * _TWO
        rolled = textbytes.splitmix(rolled)
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                out.append(h[:0])
            elif b - a < size:
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = textbytes.splitmix(np.array([x * _ONE + w]))[0]
                out.append(np.array([x]))
            else:
                out.append(np.unique(rolled[a : b - size + 1]))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS MinHash values of a non-empty set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            np.minimum(low, (np.multiply.outer(_A, part) + _B[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    at = textbytes.splitmix(samples ^ _B) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def _least_differing(percent: int) -> int:
    """Differing bits of two sketches above which a pair is ruled out."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - percent / 100 + MARGIN) / SKETCH_BITS)))


def _signatures(size: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in textbytes.slices(whole)):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            ones, twos = [], []
            with np.errstate(over="ignore"):
                for s in sets:
                    # two sums over independent mixes name the set
                    ones.append(int(textbytes.splitmix(s).sum(dtype=np.uint64).view(np.int64)))
                    twos.append(int(textbytes.splitmix(s * _TWO + _ONE).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(TEXT_HASH), pa.array([len(s) for s in sets], pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], names=["doc_id", TEXT_HASH, "n_shingles", "set_1", "set_2"])

    return rows


def _sketches(size: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in textbytes.slices(whole)):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            place, keys, sketches = [], [], []
            for i, s in enumerate(sets):
                if len(s):
                    low = minhash(s)
                    with np.errstate(over="ignore"):
                        mixed = textbytes.splitmix(low).reshape(BANDS, ROWS) * (np.arange(ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                        band = textbytes.splitmix(mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ONE)
                    place.append(i)
                    keys.append(band.view(np.int64))
                    sketches.append(odd_sketch(low))
            n = len(place)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(np.concatenate(x) if n else [], pa.int64())) for x, w in ((keys, BANDS), (sketches, SKETCH_BITS // 64))]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(place, pa.int64())), *lists], names=["node", "keys", "sketch"])

    return rows


def _sets(size: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in textbytes.slices(whole)):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return rows


def _confirm(percent: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _differences(percent: int):
    """Of each pair (a, b): the shingles in which a and b differ, and what a needs of shared ones."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            need, differ = [], []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                d = np.setxor1d(x, y, assume_unique=True).view(np.int64)
                need.append((100 + percent) * len(d) - (100 - percent) * len(x))
                differ.append(d)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(need, pa.int64()), pa.array(differ, pa.list_(pa.int64()))], names=["node", "pivot", "need", "differs"])

    return rows


def _differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    out = pairs
    for end in ("a", "b"):
        side = sets.select(F.col("node").alias("_n"), F.col("shingles").alias(f"set_{end}"))
        out = out.join(side.hint("merge"), out[end] == side["_n"]).drop("_n")
    return out.select("a", "b", "set_a", "set_b")


def _linked(pairs: DataFrame, best: DataFrame, sets: DataFrame, percent: int, parents: DataFrame | None) -> DataFrame | None:
    """Components by the pairs (a, b) whose full sets are similar enough: of ``best`` first, then of those still between components."""
    rest = best
    for k in range(2):
        links = written(_with_sets(rest, sets).mapInArrow(_confirm(percent), "a long, b long"), "links")
        parents = components(links, parents)
        if k == 0:
            rest = written(pairs.select("a", "b") if parents is None else _between(pairs.select("a", "b"), parents), "rest")
        discard(links)
    discard(rest)
    return parents


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id: one row per row of ``docs``."""
    return _classified(docs, shingle_words, percent, id_col, text_col).drop(TEXT_HASH)


def _classified(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = docs.withColumn(TEXT_HASH, text_hash(F.col("text")))
    marks = written(hashed.mapInArrow(_signatures(shingle_words), f"doc_id long, {TEXT_HASH} long, n_shingles long, set_1 long, set_2 long"), "marks")
    repeats = not marks.groupBy("doc_id").count().filter("count > 1").isEmpty()
    once = lambda df, what: df.dropDuplicates(["node", what]) if repeats else df
    # a node is a class of equal sets, named by its smallest doc_id
    by_set = ["n_shingles", "set_1", "set_2"]
    nodes = written(marks.filter("n_shingles > 0").groupBy(*by_set).agg(F.min("doc_id").alias("node")), "nodes")
    head = small(written(nodes.filter("node is not null").select("node").distinct(), "heads"))
    texts = docs.join(head, docs["doc_id"] == head["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    sketches = written(once(texts.mapInArrow(_sketches(shingle_words), "node long, keys array<long>, sketch array<long>"), "keys"), "sketches")

    members = sketches.select("node", F.explode("keys").alias("key"))
    pivots = written(members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).filter("pivot <> _last").select("key", "pivot"), "pivots")
    stars = written(members.join(pivots.hint("merge"), "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    sk = sketches.select("node", "sketch")
    a, b = sk.select(F.col("node").alias("_na"), F.col("sketch").alias("_sa")), sk.select(F.col("node").alias("_nb"), F.col("sketch").alias("_sb"))
    near = stars.join(a.hint("merge"), stars["a"] == a["_na"]).join(b.hint("merge"), stars["b"] == b["_nb"]).select("a", "b", _differing(F.col("_sa"), F.col("_sb")).alias("differing"))
    near = written(near.filter(F.col("differing") <= _least_differing(percent)), "near")
    wanted = written(stars.select("a").union(pivots.select("pivot")).toDF("node").distinct(), "wanted")
    keep = small(wanted)
    found = docs.join(keep, docs["doc_id"] == keep["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = written(once(found.mapInArrow(_sets(shingle_words), "node long, shingles binary"), "shingles"), "sets")
    discard(wanted, pivots, sketches)

    best = written(near.groupBy("a").agg(F.min(F.struct("differing", "b")).alias("_b")).select("a", F.col("_b.b").alias("b")), "best")
    parents = _linked(near, best, sets, percent, None)
    discard(near, best)
    parents = _crossing(stars, sets, percent, parents)
    discard(stars, sets)

    named = nodes if parents is None else nodes.join(parents.select("node", "parent").hint("merge"), "node", "left")
    named = written(named.select(*by_set, "node", (F.col("node") if parents is None else F.coalesce("parent", "node")).alias("component")), "named")
    out = marks.join(named.hint("merge"), by_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("class_id"), TEXT_HASH)


def _parts(members: DataFrame, parents: DataFrame | None) -> DataFrame:
    """``members`` with the component, ``part``, of each node."""
    if parents is None:
        return members.withColumn("part", F.col("node"))
    return members.join(parents.select("node", "parent").hint("merge"), "node", "left").withColumn("part", F.coalesce("parent", "node")).drop("parent")


def _crossing(stars: DataFrame, sets: DataFrame, percent: int, parents: DataFrame | None) -> DataFrame | None:
    """Components, carried on with the links between members of one pivot.

    With need(x) = (100 + percent) |dx| - (100 - percent) |x|, members x and y are
    linked when 2 (100 + percent) |dx & dy| >= need(x) + need(y).
    """
    members = _parts(stars.select(F.col("a").alias("node"), F.col("b").alias("pivot")), parents)
    mixed = members.groupBy("pivot").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p <> _q").select("pivot")
    mixed = written(mixed, "mixed")
    asked = stars.join(small(mixed), stars["b"] == mixed["pivot"], "left_semi")
    each = 2 * (100 + percent)
    differ = written(_with_sets(asked, sets).mapInArrow(_differences(percent), "node long, pivot long, need long, differs array<long>"), "differences")
    least = written(differ.groupBy("pivot").agg(F.min(F.struct("need", "node")).alias("_l")).select("pivot", F.col("_l.need").alias("least"), F.col("_l.node").alias("first")), "least")
    rows = differ.join(small(least), "pivot")
    sure = rows.filter((F.col("need") + F.col("least") <= 0) & (F.col("node") != F.col("first"))).select(F.greatest("node", "first").alias("a"), F.least("node", "first").alias("b")).distinct()
    sure = written(sure if parents is None else _between(sure, parents), "sure")
    parents = components(sure, parents)

    # members that need a shared shingle with whatever other, and the least need among them
    far = F.col("need") + F.col("least") > 0
    other = written(rows.filter(far).groupBy("pivot").agg(F.min("need").alias("least_far")), "least-far")
    shingles = _parts(rows.join(small(other), "pivot"), parents).select("pivot", "node", "part", "need", "least", "least_far", F.explode("differs").alias("shingle"))
    shingles = written(shingles, "difference-shingles")
    often = shingles.groupBy("pivot", "shingle").agg(F.count("*").alias("n"), F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p <> _q").select("pivot", "shingle", "n")
    often = written(often, "common")
    common = shingles.join(often.hint("merge"), ["pivot", "shingle"])
    after = F.row_number().over(Window.partitionBy("pivot", "node").orderBy(F.col("n").desc(), F.col("shingle").desc())) - 1
    common = written(common.withColumn("after", after).filter(each * (1 + F.col("after")) >= F.col("need") + F.least("least", "least_far")), "prefixes")
    reach = lambda limit: each * (1 + F.col("after")) >= F.col("need") + F.col(limit)
    y = common.filter(far & reach("least"))
    x = common.filter(reach("least_far"))
    with scope() as kept:
        met = _within(x, y, percent).filter((F.col("part") != F.col("_part")) & (each * (1 + F.least("after", "_after")) >= F.col("need") + F.col("_need")))
        met = written(met.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct(), "crossing")
        kept.append(met)
    best = written(met.groupBy("a").agg(F.min("b").alias("b")), "best")
    parents = _linked(met, best, sets, percent, parents)
    discard(mixed, differ, least, sure, other, shingles, often, common, met, best)
    return parents


#: Rows that stand beside each other in the order of needs and are met as one block.
BLOCK = 16


def _counted(batches: Iterator) -> Iterator:
    """The rows of one range, with its number and how many of them up to each are partners (kind 0)."""
    import pyarrow as pa
    from pyspark import TaskContext

    deal, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        upto = n + np.cumsum(batch.column("kind").to_numpy() == 0, dtype=np.int64)
        n = int(upto[-1]) if len(upto) else n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(upto), deal, np.int32)), pa.array(upto)], names=[*batch.schema.names, "deal", "upto"])


def _within(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Rows of ``x`` beside rows ``_`` of ``y`` that share (pivot, shingle), need no less and no more than x allows.

    The shared shingle allows x a partner of need up to 2 (100 + percent) (1 + after)
    - need(x), and of two members the one of smaller need (of smaller node, if equal)
    is x: in the order of (pivot, shingle, need, node) x's partners are a run of rows of
    y. One sort of y's rows and of both ends of x's runs, dealt by ranges so that no
    group is in one task, gives each row of y its place and each x its run. The places
    are cut into blocks of BLOCK; x meets the blocks of its run by an equi-join. So there
    is one row for each of y, two ends for each x that any partner may suit, and rows
    that meet only where the run holds.
    """
    most = 2 * (100 + percent) * (1 + F.col("after")) - F.col("need")
    columns, order = ["pivot", "shingle", "node", "part", "need", "after"], ["pivot", "shingle", "at", "by", "kind"]
    mark = lambda at, by, kind: F.struct(at.alias("at"), by.cast("long").alias("by"), F.lit(kind).alias("kind"))
    ends = F.explode(F.array(mark(F.col("need"), F.col("node"), 1), mark(most, F.lit((1 << 63) - 1), 2)))
    rows = y.select(*columns, mark(F.col("need"), F.col("node"), 0).alias("_m")).union(x.filter(most >= F.col("need")).select(*columns, ends.alias("_m"))).select(*columns, "_m.*")
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = written(dealt.mapInArrow(_counted, "pivot long, shingle long, node long, part long, need long, after int, at long, by long, kind int, deal int, upto long"), "needs")
    # one row for each range
    before = dealt.groupBy("deal").agg(F.max("upto").alias("_n")).select("deal", F.coalesce(F.sum("_n").over(Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = dealt.join(F.broadcast(before), "deal").withColumn("_upto", F.col("upto") + F.col("_before"))
    y = placed.filter("kind = 0").select(*(F.col(c).alias(f"_{c}") for c in columns[2:]), (F.col("_upto") - 1).alias("_place")).withColumn("_block", F.expr(f"_place div {BLOCK}"))
    x = placed.filter("kind > 0").groupBy(*columns).agg(F.min("_upto").alias("_from"), F.max("_upto").alias("_to")).filter("_from < _to")
    x = x.withColumn("_block", F.explode(F.expr(f"sequence(_from div {BLOCK}, (_to - 1) div {BLOCK})")))
    return x.hint("merge").join(y, "_block").filter("_place >= _from and _place < _to").drop("_block", "_place", "_from", "_to")


def _between(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    out = pairs
    for end in ("a", "b"):
        p = parents.select(F.col("node").alias("_n"), F.col("parent").alias(f"_{end}"))
        out = out.join(p.hint("merge"), out[end] == p["_n"], "left").drop("_n")
    return out.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text's component has their doc_id as its smallest; of repeated rows one.

    Rows of null doc_id stand for themselves: they are kept unless an equal set
    belongs to a document that has an id.
    """
    # fewer rows go than stay
    gone = written(_classified(docs, **settings).filter("not kept").select("doc_id", TEXT_HASH).distinct(), "gone")
    rows = only_rows(docs, gone, "left_anti")
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        # equal rows of one doc_id are one document; rows without one are not
        row = rows.select(F.struct("*").alias("_row"))
        text = F.coalesce("_row.text", F.lit(""))
        key = {"_id": F.col("_row.doc_id"), "_own": F.when(F.col("_row.doc_id").isNull(), F.monotonically_increasing_id()), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)}
        rows = row.withColumns(key).dropDuplicates(list(key)).select("_row.*")
    return rows
