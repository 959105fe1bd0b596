"""Canonical forms and record shapes, all as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.contracts import Type


def canonicalize(t: Type, c: Column) -> Column:
    """The nearest canonical form of the chain; the value itself if there is none. NULL: has no form."""
    form = t.canonical_form()
    return form(c) if form else c


def canonicalize_record(df: DataFrame, **forms: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({n: f(F.col(n)) for n, f in forms.items()})


def with_defaults(df: DataFrame, contract: Type) -> DataFrame:
    """``df`` with the default of each field of a record contract where its column is null or lacking."""
    filled = {}
    for fields in contract.enforced().get("fields", []):
        for f in fields:
            if f.default is not None:
                filled[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.lit(f.default)) if f.name in df.columns else F.lit(f.default)
    return df.withColumns(filled)


def record_of(**fields: Column) -> Column:
    """A record of the given fields in the given order; it may hold records and arrays."""
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def flatten_fields(df: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """One row for each (row, field): keys, field, value as text."""
    return df.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(keys, list(fields), "field", "value")


def record_equal(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Null-safe equality of two records whatever the order of their fields."""
    if a.keys() != b.keys():
        return F.lit(False)
    out = F.lit(True)
    for n in sorted(a):
        out = out & a[n].eqNullSafe(b[n])
    return out


def fingerprint(df: DataFrame, *columns: str) -> Column:
    """MD5 of the record as JSON, fields by name; nulls count."""
    return F.md5(F.to_json(F.struct(*(F.col(c) for c in sorted(columns or df.columns))), {"ignoreNullFields": "false"}))


def merged_map(base: Column, override: Column) -> Column:
    """``base`` with the entries of ``override``, which win; base entries first."""
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(override), k))
    return F.map_concat(rest, override)


def merge_attributes(base: DataFrame, override: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Key-wise merge of two tables of (keys, value): the right side wins."""
    o = override.select(*keys, F.col(value).alias("_override"), F.lit(True).alias("_has"))
    return base.join(o, keys, "full").select(*keys, F.when(F.col("_has"), F.col("_override")).otherwise(F.col(value)).alias(value))


def stamped(df: DataFrame, from_files: bool = False, **values: str) -> DataFrame:
    """Provenance on every row: the given literals and, for a file scan, the source file and its directory."""
    out = df.withColumns({f"_{k}": F.lit(v) for k, v in values.items()})
    if from_files:
        out = out.withColumn("_file", F.col("_metadata.file_path")).withColumn("_directory", F.regexp_replace("_file", "/[^/]*$", ""))
    return out


def qualified_key(stem: Column, name: Column, kind: Column | None = None) -> Column:
    key = F.concat(F.regexp_replace(stem, r"\.[^./]*$", ""), F.lit(":"), name)
    return key if kind is None else F.concat(kind, F.lit("/"), key)
