"""Best-fit packing of token sequences by bin completion.

Documents are tokenized, cut into pieces of at most the capacity, and packed
into as few sequences as possible. Only the number of pieces of each length
matters for a plan, so the search runs on that histogram, whose size is bounded
by the capacity whatever the data: bin completion fills a bin around the largest
length left with an undominated filling, in order of waste, and uses the filling
for as many bins as the counts allow, or for one and goes on. Best-fit decreasing gives the incumbent
and the sum of lengths the lower bound; a branch stops once the waste spent
rules out fewer bins than the incumbent has. A plan is known to be best if it meets the
bound, or if the search ended by itself and no enumeration of fillings was cut short;
``plan`` says so.

Pieces then find their places without meeting in one task: the task that tokenizes
them numbers those of each length as it goes, sums over the tasks give the numbers that
come before, and a range of numbers belongs to a row of the plan.

Null and empty texts are documents of one end id. A text of any length is tokenized in
runs and cut; only its ids are held. Repeated rows are packed each for itself, and ids
play no part in the order, so null or repeated ones cost nothing. Ties of lengths go by
the order of the tasks. An empty table gives an empty result. Columns other than doc_id
and text, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm import textbytes
from pactum.llm.tokens import END_ID, default_tokenizer
from pactum.plans.scratch import small, written

CAPACITY = 4096

#: Branch-and-bound limits per search: bins entered, and fillings tried for one bin.
SEARCH_NODES, FILLINGS = 2_000, 8


def _pieces(tokenizer: str, capacity: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from pactum.llm.tokens import encoder

        enc, part_id = encoder(tokenizer), TaskContext.get().partitionId()
        given: dict[int, int] = {}
        for batch in (part for whole in batches for part in textbytes.slices(whole, "_text")):
            ids, ends = enc.encode_all(batch.column("_text").to_pylist())
            row, piece, start, length, crc, number = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                mine = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for p, at in enumerate(range(0, len(mine), capacity)):
                    part = mine[at : at + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    number.append(given.get(len(part), 0))
                    given[len(part)] = number[-1] + 1
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(pa.array(row, pa.int64())) for n in kept), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part_id] * len(row), pa.int32()), pa.array(number, pa.int64())],
                names=[*kept, "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    return rows


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task and its number among that task's pieces of the length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long")


# --- the plan on the histogram of lengths -------------------------------------------------------------


class _Lengths:
    """How many pieces of each length are left; lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.left)

    def take(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for length, n in filling:
            self.left[length] -= n * times
            if not self.left[length]:
                del self.left[length]
                self.order.pop(bisect.bisect_left(self.order, length))

    def give(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for length, n in filling:
            if length not in self.left:
                self.left[length] = 0
                bisect.insort(self.order, length)
            self.left[length] += n * times


def _best_fit(lengths: _Lengths, capacity: int) -> tuple[tuple[int, int], ...]:
    """Largest length left, then again and again the largest that still fits."""
    out, room, at = [], capacity, len(lengths.order)
    while at and (at := bisect.bisect_right(lengths.order, room, 0, at)):
        length = lengths.order[at - 1]
        n = min(lengths.left[length], room // length)
        out.append((length, n))
        room -= n * length
        at -= 1
    return tuple(out)


def _dominated(lengths: _Lengths, filling: dict[int, int], room: int) -> bool:
    """Whether a length can be added, or one but the largest swapped for a longer one that is left and still fits."""
    order, left = lengths.order, lengths.left
    for length in [0, *filling]:
        for i in range(bisect.bisect_right(order, length), bisect.bisect_right(order, length + room)):
            if filling.get(order[i], 0) < left[order[i]]:
                return True
    return False


def _fillings(lengths: _Lengths, capacity: int, most: int) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """Undominated fillings around the largest length, least waste first, and whether these are all.

    Each length is tried from as often as it fits down to not at all, from longer
    to shorter. A filling that a single swap or addition improves is dominated and
    left out. The enumeration stops after a bounded number of steps.
    """
    order, left = lengths.order, lengths.left
    top = order[-1]
    room = capacity - top
    # a piece that fills the room exactly: no other filling can do better
    if room in left and (room != top or left[top] > 1):
        return [((top, 1), (room, 1)) if room != top else ((top, 2),)], True
    first = _best_fit(lengths, capacity)
    found: dict[tuple[tuple[int, int], ...], int] = {first: capacity - sum(a * n for a, n in first)}
    steps = 0
    # longest lengths first; (filling, room, lengths still below)
    stack: list[tuple[tuple[tuple[int, int], ...], int, int]] = [(((top, 1),), room, len(order))]
    while stack and steps < 32 * most and len(found) < 8 * most:
        steps += 1
        chosen, room, below = stack.pop()
        at = bisect.bisect_right(order, room, 0, below)
        if not at:
            if not _dominated(lengths, dict(chosen), room):
                found.setdefault(chosen, room)
            continue
        length = order[at - 1]
        free = left[length] - (length == top)
        for n in range(min(free, room // length) + 1):
            if not n:
                more = chosen
            elif length == top:
                more = ((top, n + 1),)
            else:
                more = (*chosen, (length, n))
            stack.append((more, room - n * length, at - 1))
    best = sorted(found, key=lambda f: (found[f], len(f), [-a for a, _ in f]))
    return best[:most], not stack and len(best) <= most


def _times(lengths: _Lengths, filling: tuple[tuple[int, int], ...]) -> int:
    return min(lengths.left[length] // n for length, n in filling)


def _decreasing(lengths: _Lengths, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing, whole runs of equal bins at a time."""
    out = []
    while lengths.order:
        filling = _best_fit(lengths, capacity)
        n = _times(lengths, filling)
        out.append((filling, n))
        lengths.take(filling, n)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], bool]:
    """Fillings and how many bins use each, for ``counts`` pieces of each length, and whether fewer bins are ruled out."""
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // capacity)
    best = _decreasing(_Lengths(counts), capacity)
    bins = sum(n for _, n in best)
    lengths = _Lengths(counts)
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    # one frame for each bin that is open: the fillings still to try
    frames: list[list] = []
    used, waste, nodes = 0, 0, 0
    fresh = whole = True
    while bins > bound and nodes < SEARCH_NODES + 2 * capacity:
        if fresh and not lengths.order:
            if used < bins:
                best, bins = list(done), used
            fresh = False
        if fresh:
            nodes += 1
            # each for as many bins as it can fill, then each for one bin, after which all may follow again
            found, all_ = _fillings(lengths, capacity, FILLINGS)
            tried, whole = [(f, _times(lengths, f)) for f in found], whole and all_
            frames.append(tried + [(f, 1) for f, n in tried if n > 1])
        else:
            if not done:
                break
            filling, n = done.pop()
            lengths.give(filling, n)
            used, waste = used - n, waste - n * (capacity - sum(a * c for a, c in filling))
        fresh = False
        while frames[-1]:
            filling, n = frames[-1].pop(0)
            more = n * (capacity - sum(a * c for a, c in filling))
            if waste + more > (bins - 1) * capacity - total:  # no longer better than the incumbent
                continue
            done.append((filling, n))
            lengths.take(filling, n)
            used, waste, fresh = used + n, waste + more, True
            break
        if not fresh:
            frames.pop()
            if not frames:
                return best, bins == bound or whole
    return best, bins == bound


def plan_rows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, pieces of it in a sequence, offset) rows of a plan."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan(counts, capacity)[0]:
        at = 0
        for length, n in filling:
            first = given.get(length, 0)
            given[length] = first + n * times
            out.append((length, first, given[length], sequence, n, at))
            at += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with columns length, task, number) with sequence_id and offset."""
    spark = pieces.sparkSession
    per_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("_n")), "counts")
    # at most ``capacity`` rows reach the driver, whatever the data
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan_rows(counts, capacity)
    table = spark.createDataFrame(rows, "p_length long, p_first long, p_end long, p_sequence long, p_each long, p_offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per_task.select("length", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    numbered = pieces.join(small(offsets), ["length", "task"]).withColumn("_at", F.col("number") + F.col("_before"))
    # a plan has at most a few rows for each length, so the range of numbers is found by a hash join on the length
    per_length = table.groupBy("p_length").agg(F.array_sort(F.collect_list(F.struct("p_first", "p_end", "p_sequence", "p_each", "p_offset"))).alias("_plan"))
    placed = numbered.join(F.broadcast(per_length), F.col("length") == F.col("p_length")).withColumn("_row", F.element_at(F.filter("_plan", lambda r: (r["p_first"] <= F.col("_at")) & (F.col("_at") < r["p_end"])), 1))
    within = F.col("_at") - F.col("_row.p_first")
    return placed.withColumn("sequence_id", F.col("_row.p_sequence") + F.floor(within / F.col("_row.p_each"))).withColumn("offset", F.col("_row.p_offset") + F.pmod(within, F.col("_row.p_each")) * F.col("length")).drop("task", "number", "_before", "_at", "p_length", "_plan", "_row")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = written(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
