"""Language-model scores by context-tree weighting over bytes.

Bytes are coded as eight binary decisions, from the most significant bit down.
The decision at each node of that byte tree is modelled in the contexts of zero
to ``depth`` bytes before it. A context's counts give a Krichevsky-Trofimov block
estimate; a context of less than full depth weights its own estimate and the
product of its children's weighted estimates half and half, so all depths are
mixed by how well they explain the training text. With the counts fixed, the
mixture gives the chance of each byte in each context.

The counts are a table, a row for each string of a context and a byte, that grows
with the corpus. A number stands for a string: the byte last, before it the
context, the nearest byte first, so a shorter context is a prefix. Contexts of
``ROOT`` bytes are the roots of subtrees, dealt into buckets and weighted bottom-up
there; the contexts above are weighted by one aggregation for each depth. On the way
down each node gets what the shorter contexts leave to it, and each string its
chance. Strings that only occur in documents not learned from take part with a
count of zero. Nothing of this reaches the driver but counts of rows.

The base score is an add-one unigram model of whole words. Its word counts have
no bound either, so nothing is broadcast: documents are dealt into blocks, the
distinct words and strings of each block meet their counts and chances by a join,
and each block is scored with its own.

Null and empty texts hold the end as their only token, their model score is 0 and their
code length null; texts of any length are read whole, in slices of whole texts. Rows that
are equal in doc_id and text are counted each, scored once and returned each, so however
many they are they stand in a block once. A null id counts as empty text for the fold. A
table without words or without training rows has N = V = 0. An empty table gives an
empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import textbytes
from pactum.plans.scratch import discard, small, written

#: Bytes of context unless a caller gives more; a string of MOST_DEPTH + 2 bytes would not fit its number.
DEPTH, MOST_DEPTH = 2, 6

#: Bytes of context of the root of a subtree, and strings of a bucket of subtrees on average.
ROOT, BUCKET_STRINGS = 3, 100_000

#: Characters of text that a block of documents holds on average, and blocks at least. The larger a
#: block, the fewer of its strings are sent to it again and again.
BLOCK_CHARS, LEAST_BLOCKS = 32_000_000, 20

#: Slices of a block whose distinct items are merged at a time.
MERGE_SLICES = 2

_END = np.uint64(0xE7037ED1A0B428DB)

#: An item of a block is a string's number or, with this bit, a word's hash.
_WORD_BIT = np.uint64(1 << 63)


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    """Documents whose id, as text, has CRC-32 ``fold`` modulo ``folds`` are not learned from. A null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


# --- context-tree weighting ------------------------------------------------------------------------------


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    half = _log_rising(n0) + _log_rising(n1)
    return half - _log_factorial(n0 + n1)


def _log_rising(n: np.ndarray) -> np.ndarray:
    """log of 1/2 * 3/2 * ... * (n - 1/2)."""
    return _log_gamma(n + 0.5) - _log_gamma(np.array(0.5))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n + 1.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting x above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def _kt_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


def _own_share(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate in its weighted estimate: own / (own + children)."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


def _text_strings(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(string of each byte as a number, offsets of the texts); texts begin after zero bytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(at[:-1], sizes)
    out = data.copy()
    for j in range(1, min(depth, len(data) - 1) + 1):
        out[j:] |= np.where(place[j:] >= j, data[:-j], 0) << 8 * (depth + 1 - j)
    return out, at


class Subtrees:
    """Nodes of whole subtrees: for each depth from ``root`` on, the (context, node of the byte tree) that strings pass, as sorted numbers."""

    def __init__(self, strings: np.ndarray, count: np.ndarray, depth: int, root: int):
        byte = strings & 255
        self.node = np.stack([1 << k | byte >> (8 - k) for k in range(8)])
        self.bit = np.stack([byte >> (7 - k) & 1 for k in range(8)])
        self.depths = range(root, depth + 1)
        n = np.broadcast_to(count, self.bit.shape)
        self.nodes, self.n0, self.n1, self.own, self.log, self.children, self.up = {}, {}, {}, {}, {}, {}, {}
        for d in reversed(self.depths):
            self.nodes[d], at = np.unique(((strings >> 8 * (depth + 1 - d)) << 8 | self.node).ravel(), return_inverse=True)
            size = len(self.nodes[d])
            self.n0[d] = np.bincount(at, weights=np.where(self.bit, 0, n).ravel(), minlength=size)
            self.n1[d] = np.bincount(at, weights=np.where(self.bit, n, 0).ravel(), minlength=size)
            self.own[d] = self.log[d] = _kt(self.n0[d], self.n1[d])
            if d == depth:
                self.at = at
            else:
                below = self.nodes[d + 1]
                self.up[d + 1] = np.searchsorted(self.nodes[d], (below >> 16) << 8 | below & 255)
                self.children[d] = np.bincount(self.up[d + 1], weights=self.log[d + 1], minlength=size)
                self.log[d] = _weighted(self.own[d], self.children[d])

    def logs(self, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 chance of each string's byte, from what shorter contexts mixed and left to each node of the roots."""
        for d in self.depths:
            if d in self.up:
                mixed, left = mixed[self.up[d]], left[self.up[d]]
            share = _own_share(self.own[d], self.children[d]) if d in self.children else 1.0
            mixed, left = mixed + left * share * _kt_one(self.n0[d], self.n1[d]), left * (1 - share)
        p = mixed[self.at].reshape(self.bit.shape)
        return np.log10(np.where(self.bit, p, 1 - p)).sum(axis=0)


def _bucket_roots(depth: int, root: int):
    def rows(table):
        import pyarrow as pa

        t = Subtrees(table.column("word").to_numpy(), table.column("count").to_numpy(), depth, root)
        nodes = t.nodes[root]
        return pa.table({"bucket": pa.array(np.full(len(nodes), table.column("bucket")[0].as_py(), np.int64)), "context": pa.array(nodes >> 8), "node": pa.array((nodes & 255).astype(np.int32)), "n0": pa.array(t.n0[root]), "n1": pa.array(t.n1[root]), "log": pa.array(t.log[root])})

    return rows


def _bucket_logs(depth: int, root: int):
    def rows(strings, above):
        import pyarrow as pa

        words = strings.column("word").to_numpy()
        t = Subtrees(words, strings.column("count").to_numpy(), depth, root)
        # the rows above are those of the roots' nodes
        order = np.argsort(above.column("context").to_numpy() << 8 | above.column("node").to_numpy())
        return pa.table({"word": pa.array(words), "value": pa.array(t.logs(above.column("mixed").to_numpy()[order], above.column("left").to_numpy()[order]))})

    return rows


def _weigh(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n0, n1, children = (batch.column(c).to_numpy() for c in ("n0", "n1", "children"))
        own = _kt(n0, n1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("context", "node", "n0", "n1")), pa.array(_weighted(own, children)), pa.array(_own_share(own, children)), pa.array(_kt_one(n0, n1))], names=["context", "node", "n0", "n1", "log", "share", "one"])


def string_logs(counts: DataFrame, depth: int) -> DataFrame:
    """word, value (log10 chance of the byte after its context) of each string of a written table (word, count)."""
    root = min(ROOT, depth)
    buckets = 12 + counts.count() // BUCKET_STRINGS
    dealt = counts.select("word", "count", F.pmod(F.xxhash64(F.shiftright("word", 8 * (depth + 1 - root))), F.lit(buckets)).cast("long").alias("bucket"))
    roots = written(dealt.groupBy("bucket").applyInArrow(_bucket_roots(depth, root), "bucket long, context long, node int, n0 double, n1 double, log double"), "roots")
    levels, below = [], roots
    for _ in range(root):
        sums = below.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(*(F.sum(a).alias(b) for a, b in (("n0", "n0"), ("n1", "n1"), ("log", "children"))))
        below = written(sums.mapInArrow(_weigh, "context long, node int, n0 double, n1 double, log double, share double, one double"), "level")
        levels.append(below)
    # what the contexts so far mix, and the share that they leave to longer ones
    above = levels[-1].select("context", "node", (F.col("share") * F.col("one")).alias("mixed"), (1 - F.col("share")).alias("left"))
    join = lambda t, above: t.join(above.select(F.col("context").alias("_up"), F.col("node").alias("_node"), "mixed", "left"), (F.shiftright("context", 8) == F.col("_up")) & (F.col("node") == F.col("_node")))
    for level in reversed(levels[:-1]):
        own = F.col("left") * F.col("share")
        above = join(level, above).select("context", "node", (F.col("mixed") + own * F.col("one")).alias("mixed"), (F.col("left") - own).alias("left"))
    above = join(roots, above).select("bucket", "context", "node", "mixed", "left")
    out = written(dealt.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_bucket_logs(depth, root), "word long, value double"), "logs")
    discard(roots, *levels)
    return out


# --- words and scores -------------------------------------------------------------------------------------------------


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes as items, ordered by text, the end of each text included, and the text of each."""
    h, owner = textbytes.word_hashes(texts)
    place = np.concatenate([owner, np.arange(len(texts))])
    order = np.argsort(place, kind="stable")
    return np.concatenate([h, np.full(len(texts), _END, np.uint64)])[order] | _WORD_BIT, place[order]


class _Values:
    """Values of distinct items in a table with open addresses, for vectors of items that are all in it."""

    def __init__(self, item: np.ndarray, value: np.ndarray):
        bits = max(4, (3 * len(item) // 2).bit_length())
        self.value, self.shift, self.mask = value, np.uint64(64 - bits), (1 << bits) - 1
        self.item, self.place = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._home(item), np.arange(len(item))
        while len(left):
            slot = at[left]
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of items that want one slot the last stays
            won = self.place[slot] == left
            self.item[slot[won]] = item[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, item: np.ndarray) -> np.ndarray:
        return (item.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, item: np.ndarray) -> np.ndarray:
        at = self._home(item)
        miss = np.flatnonzero(self.item[at] != item)
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            miss = miss[self.item[at[miss]] != item[miss]]
        return self.value[self.place[at]]


def _counted(items: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct items, summed weights) for each weight, of which there are few: held out, learned once, learned more often."""
    out = []
    for w in np.unique(weights):
        some = np.sort(items[weights == w])
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.empty(0, np.int64)
        out.append((some[first], np.diff(first, append=len(some)) * w))
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items of (items, weights), ascending, and the sum of each one's weights."""
    items = np.concatenate([p[0] for p in parts])
    order = np.argsort(items)
    items = items[order]
    first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.empty(0, np.int64)
    weights = np.concatenate([p[1] for p in parts])[order]
    return items[first], np.add.reduceat(weights, first) if len(first) else weights


def _block_items(is_held: Callable, depth: int):
    def rows(table):
        import pyarrow as pa

        found = [(np.empty(0, np.int64), np.empty(0))]
        for part in textbytes.slices(table):
            texts = part.column("text").to_pylist()
            learned = np.array([0 if is_held(d) else n for d, n in zip(part.column("doc_id").to_pylist(), part.column("times").to_pylist(), strict=True)], float)
            h, owner = _tokens(texts)
            strings, at = _text_strings(texts, depth)
            found += _counted(h.view(np.int64), learned[owner]) + _counted(strings, np.repeat(learned, np.diff(at)))
            if len(found) > 4 * MERGE_SLICES:
                found = [_summed(found)]
        item, n = _summed(found)
        return pa.table({"block": pa.array(np.full(len(item), table.column("block")[0].as_py(), np.int32)), "item": pa.array(item), "n": pa.array(n.astype(np.int64))})

    return rows


def _score_block(depth: int, total: int, distinct: int, is_held: Callable):
    def rows(docs, items):
        import pyarrow as pa

        of = _Values(items.column("item").to_numpy(), items.column("value").to_numpy())
        parts = []
        for part in textbytes.slices(docs) if docs.num_rows else [docs]:
            ids, texts = part.column("doc_id"), part.column("text").to_pylist()
            h, owner = _tokens(texts)
            c, n = of[h.view(np.int64)], len(texts)
            strings, at = _text_strings(texts, depth)
            size = np.diff(at)
            score = np.bincount(np.repeat(np.arange(n), size), weights=of[strings], minlength=n)
            parts.append(
                pa.table(
                    {
                        "doc_id": ids,
                        "times": part.column("times"),
                        "held_out": pa.array([is_held(d) for d in ids.to_pylist()], pa.bool_()),
                        "n_tokens": pa.array(np.bincount(owner, minlength=n), pa.int64()),
                        "n_known": pa.array(np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64), pa.int64()),
                        "train_tokens": pa.array(np.full(n, total), pa.int64()),
                        "base_score": pa.array(np.bincount(owner, weights=np.log10((c + 1) / (total + distinct + 1)), minlength=n), pa.float64()),
                        "score": pa.array(score, pa.float64()),
                        "code_length_per_byte": pa.array(-score * np.log2(10) / np.maximum(size, 1), pa.float64(), mask=size == 0),
                    }
                )
            )
        return pa.concat_tables(parts)

    return rows


SCHEMA = "doc_id {kind}, times long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_length_per_byte double"


def _once(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, times: rows that are equal in both stand once, with how many they are."""
    key = ["doc_id", "h1", "h2"]
    repeats = written(marks.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1"), "repeats")
    if repeats.isEmpty():
        return docs.withColumn("times", F.lit(1).cast("long"))
    r = small(repeats.select(*(F.col(c).alias(f"_{c}") for c in key)))
    hashed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    same = hashed["doc_id"].eqNullSafe(r["_doc_id"]) & (hashed["h1"] == r["_h1"]) & (hashed["h2"] == r["_h2"])
    again = hashed.join(r, same, "left_semi").groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    single = hashed.join(r, same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    columns = ["doc_id", "text", "times"]
    return written(single.select(*columns).unionByName(again.select(*columns)), "once")


def score_documents(docs: DataFrame, is_held: Callable = held_out, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length_per_byte (bits; null without
    a byte) for every row; contexts of up to ``depth`` bytes."""
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must lie between 1 and {MOST_DEPTH}")
    docs = docs.select("doc_id", "text")
    marks = written(docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("chars")), "marks")
    chars = marks.agg(F.sum("chars")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-chars // BLOCK_CHARS))
    dealt = _once(docs, marks).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    items = written(dealt.groupBy("block").applyInArrow(_block_items(is_held, depth), "block int, item long, n long"), "items")
    counts = written(items.groupBy("item").agg(F.sum("n").alias("count")), "counts")
    words = counts.filter("item < 0")
    total, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.when(F.col("count") > 0, 1))).first()
    logs = string_logs(counts.filter("item >= 0").select(F.col("item").alias("word"), "count"), depth)
    values = words.select("item", F.col("count").cast("double").alias("value")).unionByName(logs.select(F.col("word").alias("item"), "value"))
    known = items.select("block", "item").join(values.hint("merge"), "item").select("block", "item", "value")
    schema = SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString())
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score_block(depth, total, distinct, is_held), schema)
    return scored.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("_again")).drop("times", "_again")
