"""Exact top-k by inner product on a bit-sliced index.

The vectors' components are integers. The index keeps, for each block of rows
and each dimension, bitmaps of the rows: one for each binary digit of the
component above the block's least. A query's scores are added up for all rows of
a block at once: a digit of a query component adds that dimension's slices,
shifted, into counters of bitmaps, by carry-save additions. The top rows are
selected from the most significant slice of the sums downward, and rows that tie
at the boundary are resolved by their exact scores and ids.

Each row is shuffled once, into its block, whose slices are built once and written.
Queries are sent to the blocks and stream past each index one by one, so a task
holds one block and one batch of queries, however many there are. Each block hands on
k rows a query; the best of all blocks are then ranked.

Vectors that are null or empty, or hold a null or non-finite component, take no part,
neither do vectors of another length than the query's. All others do, whatever their
size: scores are added up in as many slices as they need, and a component or a score
among the best that is beyond a long is an error, never a loss. Repeated rows are
candidates each; a query's own row is not, that is, one row of its id and vector. Equal
query rows are asked once; different vectors under one query id are ranked each for
itself, and are candidates for each other. A null id is an ordinary candidate, last among
ties, and asks nothing. Ties go to the smaller id. An empty table gives an empty result.
Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.plans.scratch import discard, written

#: Rows of a block of the index at most and, so that small tables keep all cores busy, at least.
BLOCK_ROWS, LEAST_ROWS = 65_536, 2_048


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null unless all are finite numbers, and an error where one is beyond a long."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(1 << 63))
    beyond = F.raise_error(F.lit("a component is beyond the range of long")).cast("array<bigint>")
    return F.when(~bad, F.when(far, beyond).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale))))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bitmaps [bitmap, word] of 0 and 1 [bitmap, row]."""
    words = -(-bits.shape[1] // 64)
    padded = np.zeros((bits.shape[0], words * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """Bitmaps of a block of ``n`` integer vectors: ``slices`` [slice, word], the dimension and the digit of each slice."""

    def __init__(self, n: int, least: np.ndarray, dim: np.ndarray, digit: np.ndarray, slices: np.ndarray):
        self.n, self.least, self.dim, self.digit, self.slices = n, least, dim, digit, slices
        self.words = -(-n // 64)

    @classmethod
    def of(cls, rows: np.ndarray) -> SlicedBlock:
        """Of vectors [row, dimension]."""
        least = rows.min(axis=0)
        # unsigned, as the range of a dimension may be beyond a long
        up = np.ascontiguousarray((rows.astype(np.uint64) - least.astype(np.uint64)).T)
        digits = [int(x).bit_length() for x in up.max(axis=1)]
        dim = np.repeat(np.arange(len(digits)), digits)
        digit = np.concatenate([np.arange(k) for k in digits]) if sum(digits) else np.empty(0, np.int64)
        slices = [_pack((up[d] >> np.arange(k, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)) for d, k in enumerate(digits) if k]
        return cls(len(rows), least, dim, digit, np.concatenate(slices) if slices else np.empty((0, -(-len(rows) // 64)), np.uint64))

    def _sum(self, query: np.ndarray, sign: int) -> list[np.ndarray]:
        """Bit-sliced sum over the dimensions with ``sign`` of |q| times the component above the least."""
        size = np.where(query > 0 if sign > 0 else query < 0, np.abs(query).astype(np.uint64), np.uint64(0))[self.dim]
        waiting: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            set_ = np.flatnonzero(size >> np.uint64(j) & np.uint64(1))
            for k in np.unique(self.digit[set_]).tolist():
                waiting.setdefault(j + k, []).append(self.slices[set_[self.digit[set_] == k]])
        out, w = [], 0
        while waiting:
            column = np.concatenate(waiting.pop(w, [self.slices[:0]]))
            carried = waiting.setdefault(w + 1, [])
            while len(column) > 1:  # three bitmaps of one weight make one of it and one of the next; a last two likewise
                m = len(column) // 3
                if m:
                    x, y, z = column[:m], column[m : 2 * m], column[2 * m : 3 * m]
                    t = x ^ y
                    carried.append((x & y) | (t & z))
                    column = np.concatenate([t ^ z, column[3 * m :]])
                else:
                    carried.append(column[:1] & column[1:])
                    column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            if not carried:
                del waiting[w + 1]
            w += 1
        return out

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of every row's score above a base, and the base."""
        plus, minus = self._sum(query, 1), self._sum(query, -1)
        width = max(len(plus), len(minus)) + 1
        zero, ones = np.zeros(self.words, np.uint64), np.full(self.words, np.iinfo(np.uint64).max, np.uint64)
        plus, minus = plus + [zero] * (width - len(plus)), minus + [zero] * (width - len(minus))
        # plus - minus + 2 ** (width - 1) is never negative: add the complement and one, flip the top digit
        out, carry = [], ones
        for x, y in zip(plus, minus, strict=True):
            y = ~y
            t = x ^ y
            out.append(t ^ carry)
            carry = (x & y) | (t & carry)
        out[-1] = ~out[-1]
        base = int(sum(int(q) * int(v) for q, v in zip(query, self.least, strict=True))) - (1 << (width - 1))
        return out, base

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best of the bitmap ``allowed``: all above the boundary, and all on it. Their scores."""
        slices, base = self.scores(query)
        sure, open_ = np.zeros(self.words, np.uint64), allowed.copy()
        for s in reversed(slices):
            both = sure | (open_ & s)
            n = int(np.bitwise_count(both).sum())
            if n > k:
                open_ = open_ & s
            else:
                sure, open_ = both, open_ & ~s
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
        rows = np.flatnonzero(np.unpackbits((sure | open_).view(np.uint8), bitorder="little")[: self.n])
        # beyond 62 slices in integers of any size
        kind = object if len(slices) > 62 else np.int64
        score = np.full(len(rows), base, dtype=kind)
        for w, s in enumerate(slices):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << w
        return rows, score

    def everything(self) -> np.ndarray:
        return _pack(np.ones((1, self.n), np.uint8))[0]


INDEX = "dims int, block int, kind int, query long, id long, hash long, v array<long>, ids array<long>, hashes array<long>, least array<long>, dim array<int>, digit array<int>, slices binary"


def _build(key, table):
    """The index row of one block."""
    import pyarrow as pa

    n = table.num_rows
    block = SlicedBlock.of(np.asarray(table.column("v").combine_chunks().flatten()).reshape(n, -1))
    lists = [pa.array([x], t) for x, t in ((table.column("id").to_pylist(), pa.list_(pa.int64())), (table.column("hash").to_pylist(), pa.list_(pa.int64())), (block.least, pa.list_(pa.int64())), (block.dim, pa.list_(pa.int32())), (block.digit, pa.list_(pa.int32())))]
    none = pa.nulls(1, pa.int64())
    columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([0], pa.int32()), none, none, none, pa.nulls(1, pa.list_(pa.int64())), *lists, pa.array([block.slices.tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, names=["dims", "block", "kind", "query", "id", "hash", "v", "ids", "hashes", "least", "dim", "digit", "slices"])


def _search(k: int):
    """Of a partition in which each block's index is followed by its queries: (query, query_id, id, score, own) of k + 1 rows."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = ids = hashes = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            kinds = batch.column("kind").to_pylist()
            for at, kind in enumerate(kinds):
                value = lambda c, at=at: batch.column(c)[at].as_py()  # noqa: B023, E731
                if kind == 0:
                    ids, hashes = value("ids"), value("hashes")
                    slices = np.frombuffer(value("slices"), np.uint64).reshape(-1, -(-len(ids) // 64))
                    index = SlicedBlock(len(ids), *(np.array(value(c), np.int64) for c in ("least", "dim", "digit")), slices)
                    every = index.everything()
                    continue
                q, h = value("id"), value("hash")
                # one more than k: one of them may be the query's own row
                found, score = index.top(np.array(value("v"), np.int64), k + 1, every)
                for row in sorted(range(len(found)), key=lambda x: (-score[x], ids[found[x]] is None, ids[found[x]] or 0))[: k + 1]:
                    own = ids[found[row]] == q and hashes[found[row]] == h
                    for c, x in zip(out, (value("query"), q, ids[found[row]], int(score[row]), own), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.bool_())], names=["query", "query_id", "id", "score", "own"])

    return rows


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The written index of ``vectors``: a row for each block of rows of one length."""
    rows = written(_read(vectors, id_col, vector_col, scale).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    each = min(BLOCK_ROWS, max(LEAST_ROWS, rows.count() // (2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    blocks = -(-max(1, rows.count()) // each)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    index = written(dealt.groupBy("dims", "block").applyInArrow(_build, INDEX), "index")
    discard(rows)
    return index


def _read(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).filter("v is not null and size(v) > 0").withColumn("dims", F.size("v")).withColumn("hash", F.xxhash64("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, ``id_col``, score: the k best rows of ``vectors`` for each row of ``queries``."""
    index = build_index(vectors, id_col, vector_col, scale)
    asked = _read(queries, id_col, vector_col, scale).filter("id is not null").dropDuplicates(["id", "v"])
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    # a few numbers for each block
    blocks = index.select("dims", "block").groupBy("dims").agg(F.collect_list("block").alias("_blocks"))
    sent = asked.join(F.broadcast(blocks), "dims").withColumn("block", F.explode("_blocks"))
    met = index.unionByName(sent.select("dims", "block", F.lit(1).alias("kind"), "query", "id", "hash", "v"), allowMissingColumns=True)
    met = met.repartition(max(1, 2 * index.count()), "dims", "block").sortWithinPartitions("dims", "block", "kind")
    found = met.mapInArrow(_search(k), "query long, query_id long, id long, score long, own boolean")
    asked_by = Window.partitionBy("query")
    rank = F.row_number().over(asked_by.orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("own").desc()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k + 1).withColumn("_own", F.min(F.when(F.col("own"), F.col("rank"))).over(asked_by))
    left = best.filter(~F.col("rank").eqNullSafe(F.col("_own"))).withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("_own"), 1).otherwise(0))
    return left.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
