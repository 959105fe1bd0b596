"""Written intermediate tables and size-checked broadcasts.

Intermediate results that are read more than once, or that must survive lost
executors, are written as Parquet below ``spark.checkpoint.dir``, a folder that
driver and executors share. Only a local session may do without the setting: a
temporary folder then takes its place.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20

#: Bytes that a row of a broadcast table takes beside its values.
ROW_BYTES = 48

_scopes: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here. With ``partition_by`` a folder for each value."""
    path = f"{scratch_dir(df.sparkSession)}/pactum-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by or ()).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete what is written inside when the block ends, but for the tables that are put into the list it gives.

    What is built on the deleted tables must have been read or written before.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        stay = {t._scratch_path for t in kept}
        discard(*(t for t in _scopes.pop() if t._scratch_path not in stay))
        if _scopes:
            _scopes[-1].extend(kept)


def _value_bytes(column: Column, kind: T.DataType) -> int | Column:
    """Bytes of a value: a number if the type alone tells, else a Column."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = _value_bytes(F.lit(None), kind.elementType)
        if isinstance(each, int):
            return F.coalesce(F.size(column), F.lit(0)) * each + 24
        return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(24).cast("long"), lambda s, x: s + _value_bytes(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(column[f.name], f.dataType) for f in kind.fields), 16)
    return 16


def table_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory; a count alone if all its columns are of fixed width."""
    each = ROW_BYTES + sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), 0)
    if isinstance(each, int):
        return df.count() * each
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a written table when its rows, counted and measured, stay within ``most`` bytes.

    Larger tables are joined by a shuffle of both sides, which adaptive execution
    can split at hot keys.
    """
    return F.broadcast(df) if table_bytes(df) <= most else df.hint("merge")
