"""Contracts on VARIANT values, whose kinds are known only row by row.

A contract is compiled to VARIANT paths: a field of nested records is one path from the
column, elements of arrays and values of maps are visited by higher-order functions, to
any depth. The rules, their order, paths and messages are those of typed columns.

The kind of a node is told by ``schema_of_variant``, never by a cast, which would turn
"7" into 7. Booleans are no integers and integers no floats: numbers that JSON writes with
a fraction or an exponent are floats, 1.0 among them. A whole number beyond a long, which
VARIANT keeps as a decimal, is an integer. An absent node (SQL NULL) is apart from a JSON
null: the first passes unless its field is mandatory, the second is a value of the wrong
kind. A value is taken out of its node only where the node has the kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contracts import Type
from pactum.operators import checks


def step(name: str) -> str:
    """A field as a step of a VARIANT path."""
    return f'["{name}"]' if "'" in name else f"['{name}']"


def node(base: Column, path: str) -> Column:
    """The node at a path: NULL where absent, a VARIANT null where null."""
    return base if path == "$" else F.try_variant_get(base, path, "variant")


def kind_of(v: Column) -> Column:
    """integer, float, bool, string, vector, map, null, or 'other' for what JSON has no form of; NULL where absent."""
    kind = F.schema_of_variant(v)
    whole = F.abs(F.try_variant_get(v, "$", "decimal(38,0)")) > F.lit(2**63 - 1).cast("decimal(38,0)")
    decimal = F.when(kind.rlike(r"\ADECIMAL\([0-9]+,0\)\z") & whole, "integer").otherwise("float")
    return (
        F.when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "vector")
        .when(kind.startswith("OBJECT"), "map")
        .when(kind == "VOID", "null")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
        .when(kind.isin("FLOAT", "DOUBLE"), "float")
        .when(kind.startswith("DECIMAL"), decimal)
        .when(kind.isNotNull(), "other")
    )


#: The Spark types in which values of a kind are taken out of their nodes.
_TAKEN = {"integer": "decimal(38,0)", "float": "double", "bool": "boolean", "string": "string", "vector": "array<variant>", "tuple": "array<variant>", "map": "map<string,variant>"}


def taken(t: Type, v: Column) -> Column:
    """The value of a node of the kind of ``t``; NULL for any other node."""
    kind = "vector" if t.kind == "tuple" else t.kind
    return F.when(kind_of(v) == kind, F.try_variant_get(v, "$", _TAKEN[t.kind]))


def typed(t: Type, v: Column) -> Column:
    """A node as a predicate sees it: a record as a struct of its declared fields, others by their kind, a long where it is whole."""
    a = t.enforced()
    if t.abstract or t.kind == "any":
        return v
    if t.kind == "integer":
        return taken(t, v).try_cast("bigint")
    if t.kind == "map" and a.get("fields"):
        fields = {f.name: f for group in a["fields"] for f in group}
        return F.when(kind_of(v) == "map", F.struct(*(typed(f.type, node(v, f"${step(n)}")).alias(n) for n, f in fields.items())))
    if t.kind == "vector" and a.get("element"):
        return F.transform(taken(t, v), lambda x: typed(a["element"][-1], x))
    return taken(t, v)


def entries(t: Type, base: Column, path: Column, inner: bool = False, at: str = "$") -> list[Column]:
    """One Column for each rule of ``t`` at the node ``at`` of ``base``: a violation, or null where the node conforms or is absent."""
    if t.abstract or t.kind == "any":
        return []
    a, v, out = t.enforced(), node(base, at), []
    kind = kind_of(v)
    wanted = "vector" if t.kind == "tuple" else t.kind
    present = F.lit(True) if inner else v.isNotNull()
    out.append(F.when(present & ~kind.eqNullSafe(F.lit(wanted)), checks.violation(path, "kind", "TypeError", f"not {t.kind}")))
    c = taken(t, v)

    def rule(name: str, ok: Column, message: str) -> None:
        out.append(F.when(~ok, checks.violation(path, name, "ValueError", message)))

    if t.kind == "integer":
        if "min" in a:
            rule("min", c >= a["min"], f"below {a['min']}")
        if "max" in a:
            rule("max", c <= a["max"], f"above {a['max']}")
    if t.kind == "float":
        # NaN is neither below nor above a bound
        if "min" in a:
            rule("min", F.isnan(c) | (c >= a["min"]), f"below {a['min']}")
        if "max" in a:
            rule("max", F.isnan(c) | (c <= a["max"]), f"above {a['max']}")
    if t.kind in ("string", "vector"):
        n = F.length(c) if t.kind == "string" else F.size(c)
        if "min_length" in a:
            rule("min_length", n >= a["min_length"], f"shorter than {a['min_length']}")
        if "max_length" in a:
            rule("max_length", n <= a["max_length"], f"longer than {a['max_length']}")
    for p in a.get("pattern", []) if t.kind == "string" else ():
        rule("pattern", checks.full_match(c, p), f"does not match {p}")
    for e in a.get("element", []) if t.kind == "vector" else ():
        out.append(_first_bad(c, lambda x, i, e=e: entries(e, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), True)))
    for es in a.get("elements", []) if t.kind == "tuple" else ():
        fits = F.size(c) == len(es)
        out.append(F.when(~fits, checks.violation(path, "arity", "ValueError", F.concat(F.size(c).cast("string"), F.lit(f" positions, not {len(es)}")))))
        for i, e in enumerate(es):
            out += [F.when(fits, x) for x in entries(e, base, F.concat(path, F.lit(f"[{i}]")), True, f"{at}[{i}]")]
    if t.kind == "map":
        out += _map_entries(t, base, v, path, at)
    if t.kind != "tuple":
        value = typed(t, v)
        out += [F.when(value.isNotNull() & (F.coalesce(p(value), F.lit(True)) == F.lit(False)), checks.violation(path, "predicate", "ValueError", "predicate is false")) for p in t.predicates()]
    return out


def _first_bad(items: Column, rules) -> Column:
    """The first violation among the items of an array."""
    found = F.transform(items, lambda x, i: checks.first_of(rules(x, i)))
    return F.get(F.filter(found, lambda v: v.isNotNull()), 0)


def _map_entries(t: Type, base: Column, v: Column, path: Column, at: str) -> list[Column]:
    a, m, out = t.enforced(), taken(t, v), []
    keys, is_map = F.map_keys(m), m.isNotNull()
    below = lambda i: F.concat(path, F.lit("."), F.get(keys, i))
    for k in a.get("key", []):
        out.append(_first_bad(keys, lambda x, i, k=k: checks.entries(k, x, T.StringType(), below(i), True)))
    for fields in a.get("fields", []):
        must = sorted(f.name for f in fields if f.mandatory)
        if must:
            lost = F.array_compact(F.array(*(F.when(node(base, at + step(n)).isNull(), F.lit(n)) for n in must)))
            out.append(F.when(is_map & (F.size(lost) > 0), checks.violation(path, "missing", "ValueError", F.array_join(lost, ","))))
        if a.get("strict"):
            more = F.array_sort(F.array_except(keys, F.array(*(F.lit(f.name) for f in fields)).cast("array<string>")))
            out.append(F.when(F.size(more) > 0, checks.violation(path, "extra", "ValueError", F.array_join(more, ","))))
        for f in fields:
            out += [F.when(is_map, x) for x in entries(f.type, base, F.concat(path, F.lit(f".{f.name}")), False, at + step(f.name))]
    if not a.get("fields"):
        for e in a.get("value", []):
            out.append(_first_bad(F.map_values(m), lambda x, i, e=e: entries(e, x, below(i), True)))
    for names in a.get("exactly_one", []):
        have = [F.when(node(base, at + step(n)).isNotNull() & ~F.is_variant_null(node(base, at + step(n))), F.lit(n)) for n in names]
        given = F.array_compact(F.array(*have))
        out.append(F.when(is_map & (F.size(given) != 1), checks.violation(path, "exactly_one", "ValueError", F.array_join(given, ","))))
    return out


def json_rules(**types: tuple[Column, Type]) -> list[Column]:
    """Rules of columns that hold JSON as text, as (column, type) by name: text that is no JSON is a ParseError, NULL is absent."""
    out = []
    for name, (text, t) in types.items():
        v = F.try_parse_json(text)
        out.append(F.when(text.isNotNull() & v.isNull(), checks.violation(F.lit(name), "json", "ParseError", "no JSON, or a key twice")))
        out += entries(t, v, F.lit(name))
    return out
