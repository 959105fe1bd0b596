"""Version resolution: branches, tags and id prefixes; snapshot states.

Ids offer their own prefixes, one for each length that is asked for, and requests meet
them by an equi-join on the whole prefix: the join makes the matches and no other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.plans.scratch import small, written

#: Characters by which requests that no id begins with are told; ids share few such beginnings.
HEAD = 2

#: Requests that are broadcast together, if they take as few bytes as ``small`` allows.
FEW = 250_000


def parse_ref_listing(lines: DataFrame, line: str = "line") -> DataFrame:
    """(sha, ref) of tab-separated lines; others are dropped."""
    parts = F.split(F.col(line), "\t", 2)
    return lines.filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("sha"), F.trim(parts[1]).alias("ref"))


def parse_tracking_refs(lines: DataFrame, line: str = "line") -> DataFrame:
    """(sha, ref) of space-separated lines: remote branches become local ones, HEAD goes."""
    parts = F.split(F.col(line), " ", 2)
    rows = lines.filter(F.size(parts) == 2).select(parts[0].alias("sha"), parts[1].alias("ref"))
    return rows.filter(~F.col("ref").rlike(r"(\A|/)HEAD\z")).withColumn("ref", F.regexp_replace("ref", r"\Arefs/remotes/[^/]+/", "refs/heads/"))


def exact_matches(requests: DataFrame, refs: DataFrame, want: str = "want") -> DataFrame:
    """(want, branch, tag): ids of the branch and tag of that name; a peeled tag beats the plain one."""
    kind = F.when(F.col("ref").startswith("refs/heads/"), "branch").when(F.col("ref").rlike(r"\Arefs/tags/.*\^\{\}\z"), "peeled").when(F.col("ref").startswith("refs/tags/"), "tag")
    name = F.regexp_replace(F.regexp_replace("ref", r"\Arefs/(heads|tags)/", ""), r"\^\{\}\z", "")
    named = refs.select(kind.alias("_kind"), name.alias("_name"), "sha").filter("_kind is not null")
    one = lambda k: F.max(F.when(F.col("_kind") == k, F.col("sha")))
    by_name = named.groupBy("_name").agg(one("branch").alias("branch"), F.coalesce(one("peeled"), one("tag")).alias("tag"))
    return requests.select(want).distinct().join(by_name, F.col(want) == F.col("_name")).select(want, "branch", "tag")


def prefix_matches(requests: DataFrame, ids: DataFrame, want: str = "want", sha: str = "sha") -> DataFrame:
    """(want, sha): each distinct id that begins with each request, a row each; the empty request begins all.

    Requests whose first characters no id has go first. The lengths that are then asked for,
    up to that of the longest id, are few numbers. Requests of the lengths that have few are
    broadcast, and for these ids are not shuffled; the others' lengths alone make rows that are.
    """
    w = requests.select(want).filter(F.col(want).isNotNull()).distinct()
    every = ids.select(F.col(sha).alias("_sha")).filter("_sha is not null")
    heads = written(every.groupBy(F.substring("_sha", 1, HEAD).alias("_head")).agg(F.max(F.length("_sha")).alias("_longest")), "heads")
    longest = heads.agg(F.max("_longest")).first()[0] or 0
    head = small(heads.select("_head"))
    begun = w.filter(F.length(want) >= HEAD).join(head, F.substring(want, 1, HEAD) == F.col("_head"), "left_semi")
    w = written(begun.unionByName(w.filter(F.length(want) < HEAD)).filter(F.length(want) <= longest), "wants")
    counts = sorted((r["count"], r["_n"]) for r in w.groupBy(F.length(want).alias("_n")).count().collect())
    if not counts:
        return w.select(want, F.lit(None).cast("string").alias("sha")).limit(0)
    few = [n for i, (_, n) in enumerate(counts) if sum(c for c, _ in counts[: i + 1]) <= FEW]
    many = [n for _, n in counts if n not in few]
    i = every.distinct()

    def met(lengths: list[int]) -> DataFrame:
        offered = F.array(*(F.when(F.length("_sha") >= n, F.substring("_sha", 1, n) if n else F.lit("")) for n in lengths))
        keys = i.select("_sha", F.explode(F.array_compact(offered)).alias("_p"))
        return keys.join(small(w.filter(F.length(want).isin(lengths))), F.col(want) == F.col("_p")).select(want, F.col("_sha").alias("sha"))

    return reduce(DataFrame.unionByName, [met(sorted(ns)) for ns in (few, many) if ns])


def resolve_refs(requests: DataFrame, refs: DataFrame, local: DataFrame | None = None, want: str = "want", matches: DataFrame | None = None) -> DataFrame:
    """(want, status, sha, n_candidates) for each distinct request; ``matches`` are those of ``prefix_matches``, if they are known.

    Order: a branch and a tag of the name collide; branch or tag; a unique id
    prefix; several ids are ambiguous, ``n_candidates`` of them, which ``candidates``
    lists; the local fallback (want, sha); unknown.
    """
    w = requests.select(want).distinct()
    # sums with partial results: a short prefix that most ids share gathers nothing
    pre = (prefix_matches(w, refs, want) if matches is None else matches).groupBy(want).agg(F.count("*").alias("_n"), F.min("sha").alias("_sha"))
    out = w.join(exact_matches(w, refs, want), want, "left").join(pre, want, "left")
    if local is not None:
        out = out.join(local.select(want, F.col("sha").alias("_local")), want, "left")
    else:
        out = out.withColumn("_local", F.lit(None).cast("string"))
    collide = F.col("branch").isNotNull() & F.col("tag").isNotNull()
    status = F.when(collide, "collision").when(F.col("branch").isNotNull(), "branch").when(F.col("tag").isNotNull(), "tag").when(F.col("_n") == 1, "prefix").when(F.col("_n") > 1, "ambiguous").when(F.col("_local").isNotNull(), "local").otherwise("unknown")
    sha = F.when(status.isin("branch", "tag"), F.coalesce("branch", "tag")).when(status == "prefix", F.col("_sha")).when(status == "local", F.col("_local"))
    return out.select(want, status.alias("status"), sha.alias("sha"), F.when(status == "ambiguous", F.col("_n")).alias("n_candidates"))


def candidates(resolved: DataFrame, refs: DataFrame, want: str = "want", matches: DataFrame | None = None) -> DataFrame:
    """(want, sha): the ids of each ambiguous request of ``resolve_refs``, a row each."""
    asked = resolved.filter("status = 'ambiguous'").select(want)
    return prefix_matches(asked, refs, want) if matches is None else matches.join(asked, want, "left_semi")


def snapshot_status(keys: DataFrame, key: str, folders: DataFrame, sentinels: DataFrame) -> DataFrame:
    """(key, status): hit with folder and sentinel, corrupt with the folder alone, else miss."""
    f = folders.select(F.col(key), F.lit(True).alias("_folder")).distinct()
    s = sentinels.select(F.col(key), F.lit(True).alias("_sentinel")).distinct()
    status = F.when(F.col("_folder").isNull(), "miss").when(F.col("_sentinel").isNull(), "corrupt").otherwise("hit")
    return keys.select(key).join(f, key, "left").join(s, key, "left").select(key, status.alias("status"))


def pick_materialization(df: DataFrame, key: str, present: DataFrame, local: Column, remote: Column) -> DataFrame:
    """``df`` with ``location``: the local copy where the presence table has the key, else the remote one."""
    p = present.select(F.col(key)).distinct().withColumn("_here", F.lit(True))
    return df.join(p, key, "left").withColumn("location", F.when(F.col("_here"), local).otherwise(remote)).drop("_here")
