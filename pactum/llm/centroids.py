"""Centroid clustering of integer vectors, with centroids filtered by an n-simplex projection.

A few kept vectors are pivots. They span a simplex, and the distances of a vector to the
pivots place it as the apex of that simplex in as many coordinates as there are pivots.
The distances, and so the apex, of each vector are found once and written with it. The
Euclidean distance of two apexes is never above the distance of their vectors, and with
one of the two heights turned to the other side never below it. In each round the apexes
of the centroids give a lower and an upper bound for each vector and centroid; centroids
whose lower bound is above the least upper bound are left out, and the others are
compared by exact integer distances. Bounds are widened by what rounding may take, so
the result is that of comparing all.

Rounds are Spark jobs over the written vectors: tasks assign their rows and hand on one
count and sum for each centroid, which are added exactly (decimals), and the next
centroids, of fixed number, go to the tasks again.

Kept are vectors of ``dims`` components, none null or non-finite. The quantised form of
every such vector takes part: a component beyond a long, or a distance or inertia beyond
one, is an error, never a loss. Fewer kept vectors than ``k`` give as many centroids.
Rows that repeat an id are vectors each; of equal ids the smaller components come first
as starting centroids. A null id starts no centroid but is assigned like others. Ties
go to the smaller centroid. An empty table gives an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.plans.scratch import discard, written

#: Components below this in size are compared in 64-bit integers, others in integers of any size.
NARROW = 1 << 27

#: Rows that are compared with all centroids at a time.
LOT_ROWS = 1024

#: Vectors further than this from the first pivot, in least heights of the base, are compared with all centroids.
REACH = 8.0

#: Part of that reach by which bounds are widened; rounding takes less.
SLACK = 1e-4


def whole_numbers(vector: Column, dims: int, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null unless there are ``dims`` finite ones; beyond a long it is an error."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(1 << 63))
    good = (F.size(vector) == dims) & ~F.coalesce(bad, F.lit(True))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(good, F.when(far, F.raise_error(F.lit("a component is beyond the range of long")).cast("array<bigint>")).otherwise(numbers))


class Simplex:
    """The base simplex of pivots [pivot, dimension]; pivots that add no dimension are left out."""

    def __init__(self, pivots: np.ndarray):
        p = pivots.astype(np.float64)
        kept, base, heights = [], np.zeros((0, 0)), []
        for i in range(len(p)):
            distances = np.sqrt(((p[kept] - p[i]) ** 2).sum(axis=1))
            apex = self._apex(base, distances[None])[0] if kept else np.zeros(0)
            if kept and not apex[-1] > 0.1 * max(heights, default=0.0):
                continue
            heights += apex[-1:].tolist()
            grown = np.zeros((len(kept) + 1, len(kept)))
            grown[:-1, : base.shape[1]] = base
            if kept:
                grown[-1] = apex
            base = grown
            kept.append(i)
        self.pivots, self.base, self.least = pivots[kept], base, min(heights, default=1.0)

    @staticmethod
    def _apex(base: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Apex coordinates [row, pivot] from distances [row, pivot]; the last one is the height above the base."""
        n = distances.shape[1]
        out = np.zeros((len(distances), n))
        out[:, 0] = distances[:, 0]
        for i in range(1, n):
            # the vertex i lies at base[i] in the first i coordinates
            along = base[i, i - 1]
            rest = distances[:, i] ** 2 - ((out[:, : i - 1] - base[i, : i - 1]) ** 2).sum(axis=1) - (out[:, i - 1] - along) ** 2
            out[:, i - 1], x = out[:, i - 1] - rest / (2 * along), out[:, i - 1].copy()
            out[:, i] = np.sqrt(np.maximum(0.0, x**2 - out[:, i - 1] ** 2))
        return out

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Of vectors [row, dimension]."""
        wide = rows.astype(np.float64)
        distances = np.sqrt(np.stack([((wide - p) ** 2).sum(axis=1) for p in self.pivots.astype(np.float64)], axis=1))
        return self._apex(self.base, distances)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [row, centroid] of the distances of two sets of vectors, from their apexes."""
        flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
        low = np.sqrt(flat + (a[:, None, -1] - b[None, :, -1]) ** 2)
        high = np.sqrt(flat + (a[:, None, -1] + b[None, :, -1]) ** 2)
        reach = REACH * self.least
        # a vector's distance to the first pivot is the length of its apex
        near = (np.linalg.norm(a, axis=1) <= reach)[:, None] & (np.linalg.norm(b, axis=1) <= reach)[None]
        return np.where(near, low - SLACK * reach, 0.0), np.where(near, high + SLACK * reach, np.inf)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i to centroid i."""
    if max(np.abs(x.astype(np.float64)).max(initial=0) for x in (rows, centroids)) < NARROW:
        return ((rows - centroids) ** 2).sum(axis=1)
    return ((rows.astype(object) - centroids.astype(object)) ** 2).sum(axis=1)


def nearest(rows: np.ndarray, apexes: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, its squared distance, and how many distances were found exactly."""
    ends, parts, compared = simplex.apexes(centroids), [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    for at in range(0, len(rows), LOT_ROWS):
        lot = rows[at : at + LOT_ROWS]
        low, high = simplex.bounds(apexes[at : at + LOT_ROWS], ends)
        row, cluster = np.nonzero(low <= high.min(axis=1)[:, None])
        exact = squared(lot[row], centroids[cluster])
        # by row, then distance, then number
        order = np.lexsort((cluster, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], cluster[i])))
        first = order[np.searchsorted(row[order], np.arange(len(lot)))]
        parts.append((cluster[first], exact[first]))
        compared += len(row)
    return np.concatenate([c for c, _ in parts]), np.concatenate([d for _, d in parts]), compared


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _placed(simplex: Simplex, dims: int):
    """Adds each vector's apex."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column("v"), dims))
            yield batch.append_column("apex", pa.ListArray.from_arrays(pa.array(np.arange(len(apexes) + 1) * apexes.shape[1], pa.int32()), pa.array(apexes.reshape(-1))))

    return rows


def _sums(simplex: Simplex, centroids: np.ndarray):
    """One row for each centroid of a task: count and sums of its vectors."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k, dims = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            if not len(v):
                continue
            cluster, _, _ = nearest(v, _matrix(batch.column("apex"), len(simplex.pivots)), simplex, centroids)
            order = np.argsort(cluster, kind="stable")
            used, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            count[used] += n
            # sums of halves of 32 bits fit 64 bits for any batch
            for part, unit in ((v >> 32, 1 << 32), (v & 0xFFFFFFFF, 1)):
                total[used] += np.add.reduceat(part[order], first, axis=0).astype(object) * unit
        used = np.flatnonzero(count)
        sums = pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), sums], names=["cluster", "n", "sums"])

    return rows


def _assigned(simplex: Simplex, centroids: np.ndarray):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cluster, distance, _ = nearest(_matrix(batch.column("v"), centroids.shape[1]), _matrix(batch.column("apex"), len(simplex.pivots)), simplex, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, pivots: int = 12, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), dims, scale).alias("v")).filter("v is not null")
    kept = written(whole, "numbers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    # k vectors, and the pivots after them
    first = [r["v"] for r in kept.filter("vec_id is not null").orderBy(order, "v").limit(k + pivots).select("v").collect()]
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array(first[:k], np.int64)
    simplex = Simplex(np.array(first[-pivots:], np.int64))
    placed = written(kept.mapInArrow(_placed(simplex, dims), "vec_id long, v array<long>, apex array<double>"), "apexes")
    discard(kept)
    for _ in range(rounds):
        sums = placed.mapInArrow(_sums(simplex, centroids), "cluster int, n long, sums array<string>")
        wide = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows
            centroids[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
    found = written(placed.mapInArrow(_assigned(simplex, centroids), "vec_id long, cluster int, distance long"), "assigned")
    discard(placed)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia is beyond the range of long")
    about = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    about = spark.createDataFrame(about, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each of at most k clusters
    return found.join(F.broadcast(about), F.col("cluster") == F.col("_cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """The rounds written out one by one."""
    floor = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"
    near = "SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, m{0} m) GROUP BY r"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        parts.append(f"u{i} AS (SELECT c, list({floor} ORDER BY j) AS e FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(e) AS x, unnest(range({dims})) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j) GROUP BY c)")
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(u{i}.e, m{i}.e) AS e FROM m{i} LEFT JOIN u{i} USING (c))")
    parts.append(f"z AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, z.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m{rounds}.e, ',')) AS centroid_sha256
FROM z JOIN v USING (r) JOIN m{rounds} ON m{rounds}.c = z.c"""


SQL = _sql()
