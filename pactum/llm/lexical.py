"""Ranked lexical search for many items at once, with shared work done once.

Terms are the maximal runs of ASCII letters and digits and of all other characters
above ASCII, A-Z lower-cased. The items are taken in blocks of a bounded number of
terms. For each block the term sets that items share are mined: terms that exactly the
same items hold form one set, and sets that stand together in several items are paired,
round after round. The pairs are a directed acyclic graph whose leaves are sets of
terms and whose roots are the items.

Documents are read once for each block and kept as the counts of the block's terms.
They are then scored in lots: the partial score (accumulator) of a set is summed once
for all documents of a lot, a pair adds the accumulators of its two parts, and an item
adds what its own list still names. Each task hands on the k best of an item, and the
best of all tasks are ranked. Nothing but a block's plan, of bounded size, is sent to
the tasks; documents are shuffled at no step.

Null texts and texts without a term are no documents of the collection, and items
without a term rank nothing. A text of any length counts whole. Rows that repeat a doc_id
are documents each; a null doc_id is one like any other, last among ties. Equal rows of
items are asked once, different texts under one item_id are ranked each for itself, and a
null item_id is an item like any other. Equal scores are ranked by ascending doc_id.
Either table empty gives an empty result; other columns, whatever their names, play no
part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.textbytes import slices
from pactum.plans.scratch import discard, written

#: Terms of a block of items, in the mean; a single longer item is a block of its own size.
BLOCK_TERMS = 1 << 17

#: Numbers that the accumulators of a lot of documents hold at most (8 bytes each).
LOT_NUMBERS = 1 << 22

#: Bytes of a text that are split at a time.
RUN_BYTES = 1 << 20

#: A-Z in lower case; 0-9, a-z and bytes of characters beyond ASCII as they are; all others a space.
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def term_runs(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about RUN_BYTES each."""
    clean, at = (raw or b"").translate(_TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + RUN_BYTES)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def shared_sets(items: list[list[int]]) -> tuple[list[int], list[tuple[int, int]], list[list[int]]]:
    """Mine what items share: the set of each term, the pairs, and each item's list.

    ``items`` are lists of distinct terms, numbered from 0 without a gap. Sets are
    numbered from 0, pairs after them in the order in which they are to be added up.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    sets: dict[tuple[int, ...], int] = {}
    set_of = [sets.setdefault(tuple(holders[t]), len(sets)) for t in range(len(holders))]
    uses = {s: len(held) for held, s in sets.items()}
    lists = [sorted({set_of[t] for t in terms}, key=lambda s: (-uses[s], s)) for terms in items]
    pairs: dict[tuple[int, int], int] = {}
    while True:
        seen = Counter(d for x in lists for d in zip(x, x[1:], strict=False))
        if max(seen.values(), default=0) < 2:
            return set_of, list(pairs), lists
        for i, x in enumerate(lists):
            out, at = [], 0
            while at < len(x):
                pair = tuple(x[at : at + 2])
                # of two pairs that overlap the one that more items hold is made
                if seen[pair] >= 2 and seen[pair] >= seen[tuple(x[at + 1 : at + 3])]:
                    out.append(pairs.setdefault(pair, len(sets) + len(pairs)))
                    at += 2
                else:
                    out.append(x[at])
                    at += 1
            lists[i] = out


PLAN = "block int, terms array<binary>, set_of array<int>, left array<int>, right array<int>, items array<long>, lists array<array<int>>"


def _plan(key, table):
    """The plan of one block of items as one row."""
    import pyarrow as pa

    numbers: dict[bytes, int] = {}
    held = []
    for raw in table.column("raw").to_pylist():
        found = {t: None for run in term_runs(raw) for t in run}
        held.append([numbers.setdefault(t, len(numbers)) for t in found])
    set_of, pairs, lists = shared_sets(held)
    ints = pa.list_(pa.int32())
    values = [(key[0].as_py(), pa.int32()), (list(numbers), pa.list_(pa.binary())), (set_of, ints), ([a for a, _ in pairs], ints), ([b for _, b in pairs], ints), (table.column("item").to_pylist(), pa.list_(pa.int64())), (lists, pa.list_(ints))]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in values], names=["block", "terms", "set_of", "left", "right", "items", "lists"])


def _counted(terms: list[bytes]):
    """Of batches (doc_id, text): doc_id, number of terms, and counts of those in ``terms``, for texts with a term."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get = {t: i for i, t in enumerate(terms)}.get
        for batch in (part for whole in batches for part in slices(whole)):
            ids, ns, found, tfs = [], [], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                n, tf = 0, Counter()
                for run in term_runs(raw):
                    n += len(run)
                    tf.update(map(get, run))
                if n:
                    tf.pop(None, None)
                    ids.append(doc)
                    ns.append(n)
                    found.append(list(tf))
                    tfs.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return rows


class SharedScorer:
    """Scores lots of documents for all items of a plan."""

    def __init__(self, weight: np.ndarray, set_of: np.ndarray, pairs: list[tuple[int, int]], lists: list[np.ndarray], documents: int, terms: int):
        self.weight, self.set_of, self.pairs, self.lists, self.documents, self.terms = weight, set_of, pairs, lists, documents, terms
        self.sets = int(set_of.max(initial=-1)) + 1
        self.lot = max(1, LOT_NUMBERS // max(1, self.sets + len(pairs) + len(lists)))

    def accumulators(self, n: list[int], doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Partial scores [set or pair, document]; entry i is ``tf[i]`` times ``term[i]`` in document ``doc[i]``."""
        m = np.array([10 + 90 * x * self.documents // self.terms for x in n], np.int64)
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        out = np.zeros((self.sets + len(self.pairs), len(n)), np.int64)
        np.add.at(out.reshape(-1), self.set_of[term].astype(np.int64) * len(n) + doc, value)
        for i, (a, b) in enumerate(self.pairs, self.sets):
            np.add(out[a], out[b], out=out[i])
        return out

    def scores(self, *lot) -> np.ndarray:
        """Scores [item, document]."""
        made = self.accumulators(*lot)
        return np.array([made[x].sum(axis=0) for x in self.lists]).reshape(len(self.lists), -1)


def _best(scorer: SharedScorer, items: list[int], k: int):
    """Of batches of counted documents: the k best of each item in this task."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        least = np.ones(len(items), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, scorer.lot):
                part = batch.slice(at, scorer.lot)
                term, tf = (part.column(c) for c in ("term", "tf"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(term.offsets)))
                score = scorer.scores(part.column("n").to_pylist(), doc, np.asarray(term.flatten()), np.asarray(tf.flatten()))
                known = part.column("doc_id")
                null, ids = np.asarray(known.is_null()), np.asarray(known.fill_null(0))
                for i in np.flatnonzero((score >= least[:, None]).any(axis=1)):
                    c = np.flatnonzero(score[i] >= least[i])
                    c = c[np.lexsort((ids[c], null[c], -score[i][c]))[:k]]
                    best[i] = sorted([*best[i], *zip((-score[i][c]).tolist(), null[c].tolist(), ids[c].tolist(), strict=True)])[:k]
                    if len(best[i]) == k:  # equal scores may still win by their id
                        least[i] = -best[i][-1][0]
        out = [(item, None if null else doc, -score) for item, found in zip(items, best, strict=True) for score, null, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return rows


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("raw")).filter("raw is not null").distinct()
    # spaces and one bound the terms of a text from above
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["bytes"] / 6 / block_terms))
    dealt = asked.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "item", "raw")
    plans = written(dealt.groupBy("block").applyInArrow(_plan, PLAN), "plans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    parts = []
    for block in range(blocks):
        plan = plans.filter(F.col("block") == block).first()
        if plan is None or not plan["terms"]:
            continue
        counted = written(texts.mapInArrow(_counted([bytes(t) for t in plan["terms"]]), "doc_id long, n long, term array<int>, tf array<long>"), "counts")
        all_ = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if all_["n"]:
            # a number for each of the block's terms
            df = {r["term"]: r["n"] for r in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
            weight = [math.floor(1000 * math.log((2 * all_["n"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan["terms"]))]
            scorer = SharedScorer(np.array(weight, np.int64), np.array(plan["set_of"], np.int32), list(zip(plan["left"], plan["right"], strict=True)), [np.array(x, np.int64) for x in plan["lists"]], all_["n"], all_["terms"])
            parts.append(written(counted.mapInArrow(_best(scorer, plan["items"], k), "item long, doc_id long, score long"), "best"))
        discard(counted)
    found = spark.read.schema("item long, doc_id long, score long").parquet(*(p._scratch_path for p in parts)) if parts else spark.createDataFrame([], "item long, doc_id long, score long")
    discard(plans)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term),
s AS (SELECT item_id, p.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score FROM p JOIN w USING (term) JOIN d USING (r) JOIN q USING (term), a GROUP BY item_id, p.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
