"""Contract checks as native Columns.

A check yields, for a value, structs (path, rule, error_class, message) in the
order kind, min, max, elements, predicate. What a column's Spark type decides is
decided once on the driver and costs nothing per row. NULL in a typed column is
an absent value: it passes, unless a record makes the field mandatory. A null
inside an array or map is a value of the wrong kind. VARIANT columns and fields are
checked node by node (``variants``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contracts import Type

VIOLATION = "struct<path:string,rule:string,error_class:string,message:string>"

_KINDS = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "bool": (T.BooleanType,),
    "string": (T.StringType,),
    "vector": (T.ArrayType,),
    "tuple": (T.StructType,),
    "map": (T.MapType, T.StructType),
}


def violation(path: Column, rule: str, error_class: str, message: str | Column) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(error_class).alias("error_class"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def full_match(c: Column, pattern: str) -> Column:
    """The whole value matches, with Unicode classes; named groups in either spelling."""
    return c.rlike(rf"(?U)\A(?:{pattern.replace('(?P<', '(?<')})\z")


def custom(name: str, broken):
    """Register a rule kind: ``broken(value, argument)`` is true where the rule is violated."""
    if not callable(broken):
        raise TypeError("a rule kind needs a function of (column, argument)")
    if name in _CUSTOM:
        raise ValueError(f"rule kind {name!r} is already registered")
    _CUSTOM[name] = broken


_CUSTOM: dict = {}


def custom_rule(name: str, c: Column, argument, path: str) -> Column:
    if name not in _CUSTOM:
        raise KeyError(f"no rule kind {name!r}; there are {sorted(_CUSTOM)}")
    return F.when(F.coalesce(_CUSTOM[name](c, argument), F.lit(False)), violation(F.lit(path), name, "ValueError", f"{name} {argument}"))


def entries(t: Type, c: Column, dtype: T.DataType, path: Column, inner: bool = False) -> list[Column]:
    """One Column for each rule of ``t``: a violation struct, or null where ``c`` conforms."""
    if t.abstract or t.kind == "any":
        return []
    if isinstance(dtype, T.VariantType):
        from pactum.operators import variants

        return variants.entries(t, c, path, inner)
    a = t.enforced()
    out: list[Column] = []
    if not isinstance(dtype, _KINDS[t.kind]):
        broken = c.isNotNull() if not inner else F.lit(True)
        return [F.when(broken, violation(path, "kind", "TypeError", f"not {t.kind}"))]
    if inner:
        out.append(F.when(c.isNull(), violation(path, "kind", "TypeError", f"not {t.kind}")))

    def rule(name: str, ok: Column, message: str) -> None:
        out.append(F.when(~ok, violation(path, name, "ValueError", message)))

    if t.kind in ("integer", "float"):
        # NaN is neither below nor above a bound
        nan = F.isnan(c) if t.kind == "float" else F.lit(False)
        if "min" in a:
            rule("min", nan | (c >= a["min"]) if t.kind == "float" else c >= a["min"], f"below {a['min']}")
        if "max" in a:
            rule("max", nan | (c <= a["max"]) if t.kind == "float" else c <= a["max"], f"above {a['max']}")
    if t.kind in ("string", "vector"):
        n = F.length(c) if t.kind == "string" else F.size(c)
        if "min_length" in a:
            rule("min_length", n >= a["min_length"], f"shorter than {a['min_length']}")
        if "max_length" in a:
            rule("max_length", n <= a["max_length"], f"longer than {a['max_length']}")
    if t.kind == "string":
        for p in a.get("pattern", []):
            rule("pattern", full_match(c, p), f"does not match {p}")
    if t.kind == "vector":
        for e in a.get("element", []):
            out.append(_first_bad(c, e, dtype.elementType, lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    if t.kind == "tuple":
        for es in a.get("elements", []):
            names = dtype.fieldNames()
            if len(names) != len(es):
                out.append(F.when(c.isNotNull(), violation(path, "arity", "ValueError", f"{len(names)} positions, not {len(es)}")))
            else:
                for i, (e, n) in enumerate(zip(es, names, strict=True)):
                    out += [F.when(c.isNotNull(), x) for x in entries(e, c[n], dtype[n].dataType, F.concat(path, F.lit(f"[{i}]")), True)]
    if t.kind == "map" and isinstance(dtype, T.MapType):
        out += _map_entries(a, c, dtype, path)
    elif t.kind == "map":
        for fields in a.get("fields", []):
            out += record_entries(fields, a.get("strict", False), lambda n: c[n], dtype, path, c.isNotNull())
        out += [F.when(c.isNotNull(), exactly_one(group, lambda n: c[n], dtype, path)) for group in a.get("exactly_one", [])]
    if t.kind != "tuple":
        out += [F.when(c.isNotNull() & (F.coalesce(p(c), F.lit(True)) == F.lit(False)), violation(path, "predicate", "ValueError", "predicate is false")) for p in t.predicates()]
    return out


def _first_bad(c: Column, e: Type, dtype: T.DataType, path_of) -> Column:
    """The first violation among an array's elements."""
    found = F.transform(c, lambda x, i: first_of(entries(e, x, dtype, path_of(i), True)))
    return F.get(F.filter(found, lambda v: v.isNotNull()), 0)


def _map_entries(a: dict, c: Column, dtype: T.MapType, path: Column) -> list[Column]:
    from pactum.contracts import string

    keys, out = F.map_keys(c), []
    at = lambda i: F.concat(path, F.lit("."), F.element_at(keys, i + 1).cast("string"))
    for k in a.get("key", [string()]):
        out.append(_first_bad(keys, k, dtype.keyType, at))
    for fields in a.get("fields", []):
        known = F.array(*(F.lit(f.name) for f in fields))
        must = F.array(*(F.lit(f.name) for f in fields if f.mandatory)).cast("array<string>")
        lost = F.array_sort(F.array_except(must, keys))
        out.append(F.when(F.size(lost) > 0, violation(path, "missing", "ValueError", F.array_join(lost, ","))))
        if a.get("strict"):
            more = F.array_sort(F.array_except(keys, known))
            out.append(F.when(F.size(more) > 0, violation(path, "extra", "ValueError", F.array_join(more, ","))))
        for f in fields:
            out += [F.when(F.array_contains(keys, f.name), x) for x in entries(f.type, F.try_element_at(c, F.lit(f.name)), dtype.valueType, F.concat(path, F.lit(f".{f.name}")), True)]
    if not a.get("fields"):
        for v in a.get("value", []):
            out.append(_first_bad(F.map_values(c), v, dtype.valueType, at))
    return out


def record_entries(fields, strict: bool, get, dtype: T.StructType, path: Column | None = None, present: Column | None = None) -> list[Column]:
    """Rules of a record over the fields of ``dtype``, fetched by ``get``."""
    at = path if path is not None else F.lit("")
    sub = lambda n: F.concat(path, F.lit(f".{n}")) if path is not None else F.lit(n)
    names, out = set(dtype.fieldNames()), []
    must = sorted(f.name for f in fields if f.mandatory)
    lost = F.array_compact(F.array(*(F.when(get(n).isNull() if n in names else F.lit(True), F.lit(n)) for n in must))) if must else None
    if lost is not None:
        out.append(F.when(F.size(lost) > 0, violation(at, "missing", "ValueError", F.array_join(lost, ","))))
    more = sorted(names - {f.name for f in fields})
    if strict and more:
        out.append(violation(at, "extra", "ValueError", ",".join(more)))
    for f in fields:
        if f.name in names:
            out += entries(f.type, get(f.name), dtype[f.name].dataType, sub(f.name))
    return [F.when(present, x) for x in out] if present is not None else out


def exactly_one(names: tuple[str, ...], get, dtype: T.StructType, path: Column | None = None) -> Column:
    """A violation unless one of the fields has a value; a field that ``dtype`` lacks has none."""
    has = set(dtype.fieldNames())
    given = F.array_compact(F.array(*(F.when(get(n).isNotNull() if n in has else F.lit(False), F.lit(n)) for n in names)))
    return F.when(F.size(given) != 1, violation(path if path is not None else F.lit(""), "exactly_one", "ValueError", F.array_join(given, ",")))


def first_of(found: list[Column]) -> Column:
    return F.coalesce(*found) if found else F.lit(None).cast(VIOLATION)


def all_of(found: list[Column]) -> Column:
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{VIOLATION}>")


def column_rules(df: DataFrame, **types: Type) -> list[Column]:
    """Rules of single columns, in the given order."""
    return [x for name, t in types.items() for x in entries(t, F.col(name), df.schema[name].dataType, F.lit(name))]


def row_rules(df: DataFrame, contract: Type) -> list[Column]:
    """Rules of a record contract over whole rows; its predicates see the row as a struct."""
    out: list[Column] = []
    for fields in contract.enforced().get("fields", []):
        out += record_entries(fields, contract.enforced().get("strict", False), F.col, df.schema)
    out += [exactly_one(group, F.col, df.schema) for group in contract.enforced().get("exactly_one", [])]
    row = F.struct(*map(F.col, df.columns))
    return out + [F.when(F.coalesce(p(row), F.lit(True)) == F.lit(False), violation(F.lit(""), "predicate", "ValueError", "predicate is false")) for p in contract.predicates()]


# --- values whose kind is known only row by row ------------------------------------------------------------


def dynamic_kind(json: Column, path: str = "$") -> Column:
    """integer, float, bool, string, vector, map, null; 'corrupt' for text that is no JSON, NULL where absent."""
    v = F.try_parse_json(json)
    node = v if path == "$" else F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(node)
    text = F.trim(json) if path == "$" else F.get_json_object(json, path)
    number = F.when(text.rlike(r"\A-?[0-9]+\z"), "integer").otherwise("float")
    return (
        F.when(json.isNotNull() & v.isNull(), "corrupt")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "vector")
        .when(kind.startswith("OBJECT"), "map")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), number)
    )


def json_keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def missing_keys(json: Column, *names: str) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, names)), json_keys(json)))


def extra_keys(json: Column, *names: str) -> Column:
    return F.array_sort(F.array_except(json_keys(json), F.array(*map(F.lit, names))))
