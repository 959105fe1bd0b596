"""Contracts and keyed state on streams; the batch Columns are used as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pactum.operators import modes
from pactum.operators.checks import all_of
from pactum.operators.pieces import Pieces
from pactum.operators.text import EDIT, edited


def validated(stream: DataFrame, rules: list[Column]) -> DataFrame:
    """Stateless: every row with ``_violations``."""
    return stream.withColumn("_violations", all_of(rules))


def write_validated(stream: DataFrame, rules: list[Column], valid: str, quarantine: str, checkpoint: str):
    """A query that sends conforming rows to ``valid`` and the rest, with violations, to ``quarantine``."""

    def both(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            ok, bad = modes.split(batch, rules)
            # a repeated epoch overwrites its own folder
            ok.write.mode("overwrite").parquet(f"{valid}/epoch={epoch}")
            bad.write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


class VersionedState(StatefulProcessor):
    """Per key the text of the current version: the same version is ignored, any other replaces it, a removal evicts.

    Rows: version long, op string (update, remove), text string. Emits a row for
    each change. Within a micro-batch rows of a key are taken in order of ``seq``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("document", "version long, text string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        held = self._state.get() if self._state.exists() else None
        for r in batch.itertuples(index=False):
            if r.op == "remove":
                if held is not None:
                    out.append((key[0], int(r.seq), held[0], "removed", None))
                held = None
            elif held is None or held[0] != r.version:
                out.append((key[0], int(r.seq), int(r.version), "added" if held is None else "replaced", r.text))
                held = (int(r.version), r.text)
        if held is None:
            self._state.clear()
        else:
            self._state.update(held)
        yield pd.DataFrame(out, columns=["key", "seq", "version", "change", "text"])

    def close(self) -> None:
        pass


def versioned(stream: DataFrame, key: str) -> DataFrame:
    """(key, seq, version, change, text) for a stream with columns key, seq, version, op, text."""
    return stream.groupBy(key).transformWithStateInPandas(VersionedState(), outputStructType="key string, seq long, version long, change string, text string", outputMode="append", timeMode="none")


class EditFold(StatefulProcessor):
    """Per key the text after all edits so far; a key without text begins empty.

    The state of a key is a list of its pieces, with their sizes, and the pieces, each under
    its name. A batch reads the list and the pieces that its edits touch, and writes those
    anew; the list has one short row for some thousand characters. With ``texts`` the whole
    text is read and given out; without it only its size is.
    """

    def __init__(self, texts: bool = True):
        self.texts = texts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._list = handle.getValueState("pieces", "edits long, next long, names array<long>, chars array<long>, lines array<long>")
        self._texts = handle.getMapState("texts", "name long", "text string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n, next_name, names, chars, lines = self._list.get() if self._list.exists() else (0, 0, (), (), ())
        text = Pieces(names, chars, lines, lambda name: self._texts.getValue((name,))[0], next_name)
        stored = set(names)
        for e in batch[list(EDIT)].astype(object).where(batch[list(EDIT)].notna(), None).to_dict("records"):
            edited(text, {k: int(v) if k not in ("text", "seq") and v is not None else v for k, v in e.items()})
            n += 1
        for name in text.gone & stored:
            self._texts.removeKey((name,))
        for name in text.changed:
            self._texts.updateValue((name,), (text.held[name],))
        self._list.update((n, text.next_name, text.names, text.chars.tolist(), text.lines.tolist()))
        yield pd.DataFrame([(key[0], n, int(text.chars.sum()), len(stored), len(text.changed), text.text() if self.texts else None)], columns=["key", "edits", "chars", "pieces_before", "pieces_written", "text"])

    def close(self) -> None:
        pass


def edit_folded(stream: DataFrame, key: str, texts: bool = True) -> DataFrame:
    """(key, edits, chars, pieces_before, pieces_written, text): each key's text after every micro-batch that edits it."""
    out = "key string, edits long, chars long, pieces_before long, pieces_written long, text string"
    return stream.groupBy(key).transformWithStateInPandas(EditFold(texts), outputStructType=out, outputMode="update", timeMode="none")


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass; forgets the key after a while."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            if first is None and len(part):
                first = part.iloc[:1]
        if not self._seen.exists():
            self._seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def skip_seen_lately(stream: DataFrame, *keys: str, ttl_ms: int) -> DataFrame:
    """First row of each key, and the first again once it was last let pass more than ``ttl_ms`` ago: the state holds no key longer.

    A query that is to end when its data are drained needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false: processing time alone
    is reason for another batch.
    """
    return stream.groupBy(*keys).transformWithStateInPandas(FirstSeen(ttl_ms), outputStructType=stream.schema, outputMode="append", timeMode="processingTime")


def skip_seen(stream: DataFrame, *keys: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of each key. Without a watermark the state holds every key ever seen."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def looked_up(stream: DataFrame, label: str, registry: DataFrame, name: str) -> DataFrame:
    """Stream-static join with ``found``."""
    r = registry.withColumn("found", F.lit(True))
    return stream.join(r, stream[label] == r[name], "left").withColumn("found", F.coalesce("found", F.lit(False)))


class LatestRegistry:
    """A small registry rebuilt whenever its source stream delivers; unusable after a failed rebuild."""

    def __init__(self, rebuild: Callable[[DataFrame], DataFrame]):
        self.rebuild, self.current = rebuild, None

    def batch(self, rows: DataFrame, epoch: int) -> None:
        self.current = None
        self.current = self.rebuild(rows)


def new_files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", format: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into Parquet and return it as a table."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """As ``run_once`` for update mode: each micro-batch overwrites its own folder; ``epoch`` tells them apart."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(out)
