"""Label columns: parsing, path resolution, batch resolution with an error for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_target(label: Column) -> Column:
    """struct(root, package, target, fields, error) of ``@root//package:target.field...``.

    Errors, the first that applies: empty; '@' without '//'; '//' without ':';
    no ':'; empty target. Without '@' the root is NULL, with '@//' it is empty.
    """
    at = label.startswith("@")
    slashes = F.instr(label, "//")
    root = F.when(at & (slashes > 0), F.substring(label, F.lit(2), slashes - 2))
    tail = F.when(at, F.substring(label, slashes, F.length(label))).otherwise(label)
    packaged = tail.startswith("//")
    colon = F.instr(tail, ":")
    package = F.when(packaged & (colon > 0), F.substring(tail, F.lit(3), colon - 3))
    rest = F.when(colon > 0, F.substring(tail, colon + 1, F.length(tail)))
    parts = F.split(rest, r"\.", 2)
    target = parts[0]
    fields = F.when(F.instr(rest, ".") > 0, F.split(F.get(parts, 1), r"\.")).otherwise(F.array().cast("array<string>"))
    error = (
        F.when(label.isNull() | (label == ""), "empty label")
        .when(at & (slashes == 0), "@ without //")
        .when(packaged & (colon == 0), "// without :")
        .when(colon == 0, "no :")
        .when(target == "", "empty target")
    )
    ok = error.isNull()
    keep = lambda c: F.when(ok, c)
    return F.struct(keep(root).alias("root"), keep(package).alias("package"), keep(target).alias("target"), keep(fields).alias("fields"), error.alias("error"))


def parse_label(label: Column) -> Column:
    """struct(ref, inner, error): ``ref|inner`` split at the first '|'; plain '@' and '//' labels have no ref."""
    plain = label.startswith("@") | label.startswith("//")
    bar = F.instr(label, "|")
    inner = F.when(plain, label).when(bar > 0, F.substring(label, bar + 1, F.length(label)))
    error = F.when(~plain & (bar == 0), "no separator").when(~plain & ~(inner.startswith("@") | inner.startswith("//")), "bad inner label")
    ref = F.when(~plain & (bar > 0), F.substring(label, F.lit(1), bar - 1))
    ok = error.isNull()
    return F.struct(F.when(ok, ref).alias("ref"), F.when(ok, inner).alias("inner"), error.alias("error"))


def folded(path: Column) -> Column:
    """A path without '.' and empty steps, '..' taken back; NULL if it climbs above its root."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    none = F.lit(None).cast("array<string>")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(a.isNull() | ((s == "..") & (F.size(a) == 0)), none).when(s == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s))))
    return F.array_join(kept, "/")


def resolve_load_path(df: DataFrame, path: str, file: str, roots: DataFrame) -> DataFrame:
    """``df`` with ``resolved`` and ``load_error`` for ``@ROOT//p:f``, ``//p:f``, ``:sibling`` and relative paths.

    ``file`` is the loading file's path; ``roots`` is (name, path).
    """
    p = F.col(path)
    name = F.when(p.startswith("@"), F.regexp_extract(p, r"\A@([^/]*)//", 1))
    here = F.regexp_replace(F.col(file), "/?[^/]*$", "")
    r = roots.select(F.col("name").alias("_root"), F.col("path").alias("_root_path"))
    j = df.join(r, name == r["_root"], "left")
    inner = F.regexp_replace(F.regexp_replace(p, r"\A@[^/]*//|\A//", ""), ":", "/")
    full = F.when(p.startswith("@"), F.concat("_root_path", F.lit("/"), inner)).when(p.startswith("//"), inner).when(p.startswith(":"), F.concat(here, F.lit("/"), F.substring(p, F.lit(2), F.length(p)))).otherwise(F.concat(here, F.lit("/"), p))
    done = folded(full)
    error = F.when(p.startswith("@") & (F.instr(p, "//") == 0), "@ without //").when(p.startswith("@") & F.col("_root").isNull(), "unknown root").when((p.startswith("@") | p.startswith("//")) & (F.instr(p, ":") == 0), "no :").when(done.isNull(), "above the root")
    return j.withColumn("load_error", error).withColumn("resolved", F.when(error.isNull(), done)).drop("_root", "_root_path")


def resolve_targets(labels: DataFrame, label: str, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """``labels`` with ``value`` and ``status`` (ok, or why not), each on its own.

    ``roots`` is (name), ``leaves`` is (root, target, path, value) with the fields
    joined by dots, '' for the target itself. The package takes no part.
    """
    p = labels.withColumn("_p", parse_target(F.col(label))).withColumn("_root", F.col("_p.root")).withColumn("_target", F.col("_p.target")).withColumn("_path", F.array_join("_p.fields", "."))
    r = roots.select(F.col("name").alias("_rn"))
    t = leaves.select(F.col("root").alias("_tr"), F.col("target").alias("_tt")).distinct()
    v = leaves.select(F.col("root").alias("_vr"), F.col("target").alias("_vt"), F.col("path").alias("_vp"), "value")
    j = p.join(r, F.col("_root") == F.col("_rn"), "left").join(t, (F.col("_root") == F.col("_tr")) & (F.col("_target") == F.col("_tt")), "left")
    j = j.join(v, (F.col("_root") == F.col("_vr")) & (F.col("_target") == F.col("_vt")) & (F.col("_path") == F.col("_vp")), "left")
    status = F.when(F.col("_p.error").isNotNull(), F.col("_p.error")).when(F.col("_rn").isNull(), "no such root").when(F.col("_tt").isNull(), "no such target").when(F.col("_vp").isNull(), "no such field").otherwise("ok")
    return j.select(*labels.columns, F.when(status == "ok", F.col("value")).alias("value"), status.alias("status"))


def filter_paths(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """Below an included prefix and below no excluded one."""
    any_of = lambda ps: F.coalesce(*([F.when(path.startswith(p), True) for p in ps] or [F.lit(None).cast("boolean")]), F.lit(False))
    return any_of(include) & ~any_of(exclude)
