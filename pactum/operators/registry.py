"""Entity tables: last definition wins, lookup, ordered references, lineage, unions.

Registries may be large; Spark decides whether one is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.plans.scratch import written


def latest_by_name(df: DataFrame, names: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` for each name. A hash aggregate with partial maxima, so hot names cost little."""
    rest = [c for c in df.columns if c not in names]
    top = df.groupBy(*names).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_top"))
    return top.select(*names, *(F.col(f"_top.{c}").alias(c) for c in rest)).select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the lowest ``seq`` for each key; later ones are skipped."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest)).select(*df.columns)


def short_name(label: Column) -> Column:
    """One leading colon is dropped."""
    return F.regexp_replace(label, r"\A:", "")


def lookup_by_name(df: DataFrame, label: str, registry: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """``df`` with the columns of the registered entity and an ``error`` for labels without one.

    The error lists all names of the kind in order. They are one text that only rows
    without a hit meet, by a key that is null in the others; for registries whose names
    should not stand in one text, ``unresolved`` gives the labels alone and ``listing`` the
    names in parts.
    """
    have = registry if kind is None else registry.filter(F.col("kind") == kind)
    names = have.agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("_available")).withColumn("_miss", F.lit(True))
    joined = df.withColumn("_name", short_name(F.col(label))).join(have.withColumn("_hit", F.lit(True)), F.col("_name") == have[name], "left")
    joined = joined.withColumn("_miss", F.when(F.col("_hit").isNull(), True)).join(names, "_miss", "left")
    said = F.concat(F.lit("no "), F.col("_name"), F.lit("; available: "), F.coalesce("_available", F.lit("")))
    return joined.withColumn("error", F.when(F.col("_miss"), said)).drop("_name", "_hit", "_miss", "_available")


def resolve_references(df: DataFrame, key: str, labels: str, registry: DataFrame, name: str, value: str) -> DataFrame:
    """(key, resolved): the array of labels replaced by ``value`` in the same order; unknown ones stay null."""
    at = df.select(key, F.posexplode(labels).alias("_pos", "_label"))
    hit = at.join(registry.select(F.col(name).alias("_n"), F.col(value).alias("_value")), short_name(F.col("_label").cast("string")) == F.col("_n").cast("string"), "left")
    return hit.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda s: s["_value"]).alias("resolved"))


def wrong_kind(df: DataFrame, key: str, refs: str, registry: DataFrame, name: str, kind: str, wanted: str) -> DataFrame:
    """(key, ref, found): each distinct reference of an array column that names nothing of the wanted kind; ``found`` is its kind or null."""
    named = df.select(key, F.explode(refs).alias("ref")).distinct()
    r = registry.select(F.col(name).alias("_n"), F.col(kind).alias("found"))
    return named.join(r, F.col("ref") == F.col("_n"), "left").filter(~F.col("found").eqNullSafe(F.lit(wanted))).select(key, "ref", "found")


def ambiguity_count(ids: DataFrame, sha: str, length: int) -> DataFrame:
    """(prefix, n_ids): distinct ids that share each prefix of ``length`` characters."""
    return ids.groupBy(F.substring(sha, 1, length).alias("prefix")).agg(F.count_distinct(sha).alias("n_ids"))


def first_of_each_text(df: DataFrame, text: str, seq: str) -> DataFrame:
    """The row with the lowest ``seq`` of each distinct text. Only hashes of texts are shuffled, then the rows kept."""
    key = [F.xxhash64(text).alias("_h1"), F.md5(text).alias("_h2"), F.octet_length(text).alias("_n")]
    first = df.select(*key, F.col(seq).alias("_seq")).groupBy("_h1", "_h2", "_n").agg(F.min("_seq").alias("_first"))
    return df.join(first.select(F.col("_first").alias(seq)).distinct(), seq, "left_semi")


def unresolved(df: DataFrame, label: str, registry: DataFrame, name: str) -> DataFrame:
    return df.join(registry.select(F.col(name).alias("_n")), F.col(label) == F.col("_n"), "left_anti")


def lineage_edges(df: DataFrame, source: Column, **roles: str) -> DataFrame:
    """(source, role, position, target) of each array column in ``roles``; ``df`` is read once for all."""
    named = [F.struct(F.lit(role).alias("role"), F.col(c).alias("targets")) for role, c in roles.items()]
    each = df.select(source.alias("source"), F.explode(F.array(*named)).alias("_r"))
    return each.select("source", "_r.role", F.posexplode("_r.targets").alias("position", "target"))


def validate_by_type_name(df: DataFrame, type_name: str, value: str, limits: DataFrame) -> DataFrame:
    """Rows whose value breaks the limits (type_name, min, max) of the type they name, or that name none."""
    lim = limits.select(F.col("type_name").alias("_t"), "min", "max")
    joined = df.join(lim, F.col(type_name) == F.col("_t"), "left")
    v = F.col(value)
    rule = F.when(F.col("_t").isNull(), "unknown_type").when(~F.isnan(v.cast("double")) & (v < F.col("min")), "min").when(~F.isnan(v.cast("double")) & (v > F.col("max")), "max")
    return joined.withColumn("rule", rule).filter("rule is not null").drop("_t", "min", "max")


def available_names(df: DataFrame, kind: str, name: str) -> DataFrame:
    return df.groupBy(kind).agg(F.array_sort(F.collect_set(name)).alias("names"))


def listing(df: DataFrame, kind: str, name: str, part_chars: int = 4096, sep: str = ",") -> DataFrame:
    """(kind, part, first, n, names): the sorted distinct names of each kind, in texts of about ``part_chars`` characters.

    For listings of any size: names are dealt to partitions by ranges of (kind, name); a
    running count of characters within each range cuts it into parts, and the parts of the
    ranges before are counted to number them from 0. No row holds more than one part, and
    only the ranges themselves, a few for each partition, are counted in one place.
    """
    own = Window.partitionBy("_range", kind)
    sorted_ = df.select(kind, name).filter(F.col(name).isNotNull()).distinct().repartitionByRange(kind, name).withColumn("_range", F.spark_partition_id())
    names = written(sorted_, "names")
    chars = F.sum(F.length(name) + len(sep)).over(own.orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
    cut = names.withColumn("_part", F.floor(F.coalesce(chars, F.lit(0)) / part_chars))
    texts = F.array_join(F.array_sort(F.collect_list(name)), sep)
    parts = written(cut.groupBy(kind, "_range", "_part").agg(F.min(name).alias("first"), F.count("*").alias("n"), texts.alias("names")), "parts")
    before = Window.partitionBy(kind).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy(kind, "_range").agg(F.count("*").alias("_parts")).withColumn("_before", F.coalesce(F.sum("_parts").over(before), F.lit(0)))
    numbered = parts.withColumn("_place", F.row_number().over(own.orderBy("_part")) - 1).join(ranges.select(F.col(kind).alias("_k"), F.col("_range").alias("_r"), "_before"), F.col(kind).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return numbered.select(kind, (F.col("_before") + F.col("_place")).cast("int").alias("part"), "first", "n", "names")


def registry_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def priority_union(sources: list[tuple[str, DataFrame]], name: str = "name", reserved: tuple[str, ...] = ()) -> DataFrame:
    """(name, source): of a name in several sources the first source wins; private and reserved names are left out."""
    parts = [df.select(F.col(name).alias("name"), F.struct(F.lit(i).alias("rank"), F.lit(s).alias("source")).alias("_s")) for i, (s, df) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).filter(~F.col("name").startswith("_") & ~F.col("name").isin(*reserved or ("",)))
    return rows.groupBy("name").agg(F.min("_s").alias("_s")).select("name", "_s.source")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` to append: those whose key does not exist; existing rows are never touched."""
    return new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def registry_json(df: DataFrame, kind: str, key: Column) -> DataFrame:
    """(key, json): every entry as JSON, null fields included."""
    return df.select(F.concat(F.lit(f"{kind}/"), key).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def plan_json(activities: list[DataFrame], key: str, seq: str) -> DataFrame:
    """(key, json): the activities of each plan in order, each with its own fields only."""
    own = [a.select(key, seq, F.to_json(F.struct(*(c for c in a.columns if c not in (key, seq)))).alias("_json")) for a in activities]
    rows = reduce(DataFrame.unionByName, own)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seq, "_json"))), lambda s: s["_json"])
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("json"))


def attr_conflicts(attrs: DataFrame) -> DataFrame:
    """(type, attr): attributes that both a type and its direct base declare; ``attrs`` is (type, base, attr)."""
    up = attrs.select(F.col("type").alias("base"), "attr")
    return attrs.join(up, ["base", "attr"], "left_semi").select("type", "attr")


def nearest_attribute(closure: DataFrame, attrs: DataFrame) -> DataFrame:
    """(type, attr, value): what is displayed. ``closure`` is (type, ancestor, depth), ``attrs`` (type, attr, value)."""
    a = attrs.select(F.col("type").alias("ancestor"), "attr", "value")
    return closure.join(a, "ancestor").groupBy("type", "attr").agg(F.min_by("value", "depth").alias("value"))


def effective_bounds(closure: DataFrame, bounds: DataFrame) -> DataFrame:
    """(type, min, max): what is enforced: the tightest of all ancestors. ``bounds`` is (type, min, max)."""
    b = bounds.select(F.col("type").alias("ancestor"), "min", "max")
    return closure.join(b, "ancestor").groupBy("type").agg(F.max("min").alias("min"), F.min("max").alias("max"))


def header_order_violations(df: DataFrame, group: str, pos: str, is_header: Column, exempt: Column | None = None) -> DataFrame:
    """Header rows that follow another row of their group; ``exempt`` rows count as neither."""
    plain = ~is_header if exempt is None else ~is_header & ~exempt
    before = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.max(plain.cast("int")).over(before)).filter(is_header & (F.col("_before") == 1)).drop("_before")


def delta_encoded(df: DataFrame, doc: str, line: str, col: str, *ties: str) -> DataFrame:
    """Positions relative to the one before: delta_line, and delta_col, which starts anew on a new line."""
    w = Window.partitionBy(doc).orderBy(line, col, *ties)
    last_line, last_col = F.lag(line, 1, 0).over(w), F.lag(col, 1, 0).over(w)
    return df.withColumn("delta_line", F.col(line) - last_line).withColumn("delta_col", F.when(F.col(line) == last_line, F.col(col) - last_col).otherwise(F.col(col)))


def ordered_results(df: DataFrame, key: str, labels: str, registry: DataFrame, name: str, value: str) -> DataFrame:
    """(key, pos, label, value, ok): one row for each request, in request order, failures among them."""
    at = df.select(key, F.posexplode(labels).alias("pos", "label"))
    out = at.join(registry.select(F.col(name).alias("_n"), F.col(value).alias("value")), F.col("label") == F.col("_n"), "left")
    return out.select(key, "pos", "label", "value", F.col("_n").isNotNull().alias("ok")).orderBy(key, "pos")
