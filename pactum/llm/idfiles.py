"""Token-id files: ids of all documents in doc_id order, coded in blocks.

Format: a folder of Parquet parts written by Spark's own committer (so retried
or speculative tasks leave no half files, on any store that Spark reaches). A
row is a segment: the documents in it, how many ids each has, the order-0 frequencies
of its ids and the coded blocks of its ids with a checksum each (see ``idcoder``).
Documents are never split between segments; a segment closes with the document that
fills it. What a task has left after its last full segment goes into that segment, as
a short one takes a coder nearly as many steps as a full one, so a task holds the ids of
two segments and of their last documents.

Documents are dealt by ranges of (doc_id, text hash), so part p precedes part
p + 1 and rows of one doc_id may still part. Null doc_ids come first; null, empty and
blank texts hold the end id only; repeated rows are written each. An empty table gives
files without rows. Other columns, whatever their names, are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm import textbytes
from pactum.llm.rowkeys import text_hash
from pactum.llm.tokens import END_ID, default_tokenizer
from pactum.plans.scratch import written

#: Ids after which a segment is full with the document that reached it.
SEGMENT_IDS = 1 << 22

FILE_SCHEMA = "part int, segment int, doc_ids array<long>, n_tokens array<long>, n_ids long, order0 binary, block_bytes array<int>, block_crcs array<long>, payload binary"
READ_SCHEMA = "doc_id long, part int, segment int, row int, before long, n_tokens long, ids_crc32 long"


def _encode(tokenizer: str):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from pactum.llm import idcoder
        from pactum.llm.tokens import encoder

        enc, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs, sizes, held, n_held, full = [], [], [], 0, ([], [], [])

        def close(docs, sizes, held):
            nonlocal segment
            ids = np.concatenate(held)
            order0, blocks, crcs = idcoder.encode(ids)
            row = {"part": [part], "segment": [segment], "doc_ids": [docs], "n_tokens": [sizes], "n_ids": [len(ids)], "order0": [order0], "block_bytes": [[len(b) for b in blocks]], "block_crcs": [crcs], "payload": [b"".join(blocks)]}
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            segment += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in (slice_ for whole in batches for slice_ in textbytes.slices(whole)):
            ids, ends = enc.encode_all(batch.column("text").to_pylist())
            if len(ids) and int(ids.max()) >= idcoder.MOST_ID:
                raise ValueError(f"the tokenizer's id {int(ids.max())} has no code; ids end before {idcoder.MOST_ID}")
            ids = ids.astype(np.uint16)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                docs.append(doc)
                sizes.append(b - a + 1)
                held.append(np.append(ids[a:b], np.uint16(END_ID)))
                n_held += b - a + 1
                if n_held >= SEGMENT_IDS:
                    if full[0]:
                        yield close(*full)
                    full, docs, sizes, held, n_held = (docs, sizes, held), [], [], [], 0
        if full[0] or docs:
            yield close(full[0] + docs, full[1] + sizes, full[2] + held)

    return rows


def _decode(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from pactum.llm import idcoder

    for batch in batches:
        for r in batch.to_pylist():
            ends = np.cumsum(r["block_bytes"])
            ids = idcoder.decode(r["order0"], [r["payload"][e - n : e] for e, n in zip(ends, r["block_bytes"], strict=True)], r["block_crcs"], r["n_ids"])
            n = np.array(r["n_tokens"], np.int64)
            last = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(last, n, strict=True)]
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * rows, pa.int32()), pa.array([r["segment"]] * rows, pa.int32()), pa.array(range(rows), pa.int32()), *(pa.array(x, pa.int64()) for x in (last - n, n, crc))],
                names=["doc_id", "part", "segment", "row", "before", "n_tokens", "ids_crc32"],
            )


def id_segments(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of the file format for ``docs`` (doc_id, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", text_hash(F.col("text"))).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return dealt.mapInArrow(_encode(tokenizer or default_tokenizer()), FILE_SCHEMA)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    id_segments(docs, tokenizer).write.option("compression", "none").parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a read-back table of segments."""
    docs = files.mapInArrow(_decode, READ_SCHEMA)
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    # one row for each part: as many as the writing job had tasks
    parts = per_part.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_segment_start")).join(parts, "part")
    placed = docs.join(segments.select("part", "segment", (F.col("_part_start") + F.col("_segment_start")).alias("_start")), ["part", "segment"])
    return placed.select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back as a table of segments."""
    return written(id_segments(docs, tokenizer), "ids")
