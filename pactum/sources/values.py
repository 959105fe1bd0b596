"""Datasets that a value describes: read with the contract's schema, write to the location."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contracts import Type

_SPARK = {"integer": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType()}


@dataclass(frozen=True)
class Location:
    """``kind`` is posix (root, path) or s3 (bucket, prefix); other kinds have an address only."""

    kind: str
    attributes: dict[str, str]

    def uri(self) -> str:
        a = self.attributes
        if self.kind == "s3":
            return f"s3a://{a['bucket']}/{a.get('prefix', '').lstrip('/')}"
        if self.kind == "posix":
            return "/".join(x.rstrip("/") for x in (a.get("root", ""), a["path"]) if x) if a.get("root") else a["path"]
        raise ValueError(f"no data can be read from a {self.kind} location")


@dataclass(frozen=True)
class Value:
    name: str
    type: Type
    location: Location
    format: str = "parquet"


def spark_type(t: Type) -> T.DataType | None:
    """The Spark type of a contract type; None where the contract leaves it open."""
    if t.kind in _SPARK:
        return _SPARK[t.kind]
    a = t.enforced()
    if t.kind == "vector" and a.get("element"):
        inner = spark_type(a["element"][-1])
        return T.ArrayType(inner) if inner else None
    if t.kind == "map" and a.get("fields"):
        fields = [T.StructField(f.name, spark_type(f.type)) for f in a["fields"][-1]]
        return T.StructType(fields) if all(f.dataType for f in fields) else None
    return None


#: Stored types that a declared one takes in without loss.
_WIDER = {
    T.LongType(): (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    T.DoubleType(): (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType),
    T.BooleanType(): (T.BooleanType,),
    T.StringType(): (T.StringType,),
}


def _takes(declared: T.DataType, stored: T.DataType) -> bool:
    if isinstance(declared, T.ArrayType):
        return isinstance(stored, T.ArrayType) and _takes(declared.elementType, stored.elementType)
    if isinstance(declared, T.StructType):
        have = {f.name: f.dataType for f in stored.fields} if isinstance(stored, T.StructType) else {}
        return bool(have) and all(f.name in have and _takes(f.dataType, have[f.name]) for f in declared.fields)
    return isinstance(stored, _WIDER[declared])


def read_value(spark: SparkSession, value: Value, narrow: bool = True) -> DataFrame:
    """The dataset; of a record contract the declared columns in their declared types.

    A mandatory column that is not stored, or one stored in a type that the declared
    one does not take in, is a TypeError before any row is read; an optional column that
    is not stored is null. ``narrow`` leaves out the columns that are not declared.
    """
    df = spark.read.format(value.format).load(value.location.uri())
    fields = value.type.enforced().get("fields") if value.type.kind == "map" else None
    if not fields:
        return df
    stored, out = {f.name: f.dataType for f in df.schema.fields}, []
    for f in fields[-1]:
        declared = spark_type(f.type)
        if f.name not in stored:
            if f.mandatory:
                raise TypeError(f"{value.name}: no column {f.name!r}; stored are {', '.join(stored)}")
            out.append(F.lit(None).cast(declared or T.StringType()).alias(f.name))
        elif declared is None:
            out.append(F.col(f"`{f.name}`"))
        elif not _takes(declared, stored[f.name]):
            raise TypeError(f"{value.name}: {f.name!r} is {stored[f.name].simpleString()}, declared is {declared.simpleString()}")
        else:
            out.append(F.col(f"`{f.name}`").cast(declared).alias(f.name))
    return df.select(*out, *([] if narrow else [F.col(f"`{c}`") for c in stored if c not in {f.name for f in fields[-1]}]))


def write_value(df: DataFrame, value: Value, mode: str = "errorifexists") -> None:
    df.write.format(value.format).mode(mode).save(value.location.uri())


def location_violation(address: dict[str, Column], kind: Column, wanted: Location, predicate: Callable[[dict[str, Column]], Column] | None = None) -> Column:
    """NULL if an address meets every constrained attribute, each for itself, and then the predicate; else what differs.

    The predicate is given the whole address; where it is null it does not hold.
    """
    wrong = [F.when(kind != wanted.kind, "kind"), *(F.when(~address[k].eqNullSafe(F.lit(v)), k) for k, v in wanted.attributes.items())]
    if predicate is not None:
        wrong.append(F.when(~F.coalesce(predicate(address), F.lit(False)), "predicate"))
    return F.coalesce(*wrong)


def location_compatible(producer: DataFrame, consumer: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """(keys, compatible): consumer constraints that are null accept anything."""
    c = consumer.select(*keys, *(F.col(a).alias(f"_{a}") for a in attributes))
    ok = F.lit(True)
    for a in attributes:
        ok = ok & (F.col(f"_{a}").isNull() | F.col(a).eqNullSafe(F.col(f"_{a}")))
    return producer.join(c, keys).select(*keys, ok.alias("compatible"))
