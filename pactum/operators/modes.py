"""What to do with violations: flag, first, all, split, assert, summarise, observe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from pactum.operators.checks import all_of, first_of
from pactum.plans.scratch import written


def flag(df: DataFrame, rules: list[Column], name: str = "_valid") -> DataFrame:
    ok = F.lit(True)
    for r in rules:
        ok = ok & r.isNull()
    return df.withColumn(name, ok)


def first_violation(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows that fail, with the first failure in rule order; later rules are not evaluated for them."""
    return df.withColumn("_violation", first_of(rules)).filter("_violation is not null")


def all_violations(df: DataFrame, rules: list[Column], *keys: str) -> DataFrame:
    """One row for each (row, rule) that fails: ``keys``, path, rule, error_class, message."""
    return df.select(*keys, F.explode(all_of(rules)).alias("_v")).select(*keys, "_v.*")


def split(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    marked = df.withColumn("_violations", all_of(rules))
    return marked.filter(F.size("_violations") == 0).drop("_violations"), marked.filter(F.size("_violations") > 0)


def split_written(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """As ``split``, in one pass: source and rules are read once, into a written table with a folder for each of the two."""
    marked = df.withColumn("_violations", all_of(rules)).withColumn("_part", F.when(F.size("_violations") == 0, "valid").otherwise("quarantine"))
    both = written(marked, "split", partition_by=["_part"])
    # a filter on the folder's name reads that folder alone
    return both.filter("_part = 'valid'").drop("_violations", "_part"), both.filter("_part = 'quarantine'").drop("_part")


def asserted(df: DataFrame, rules: list[Column]) -> DataFrame:
    """``df``; the job fails on the first row that does not conform."""
    first = first_of(rules)
    return df.filter(F.when(first.isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", first["error_class"], first["path"], first["rule"])).cast("boolean")))


def summary(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Violations of each rule: path, rule, error_class, n."""
    return all_violations(df, rules).groupBy("path", "rule", "error_class").agg(F.count("*").alias("n"))


def report(failures: DataFrame, line: Column) -> DataFrame:
    """One row: how many failed, and a sorted line for each. The text grows with the failures; for small sets."""
    lines = F.array_sort(F.collect_list(line))
    return failures.agg(F.count("*").alias("n_failed"), F.concat(F.count("*").cast("string"), F.lit(" failed"), F.when(F.count("*") > 0, "\n").otherwise(""), F.array_join(lines, "\n")).alias("report"))


def _quality(rules: list[Column], named: dict[str, Column]) -> list[Column]:
    counts = [F.count_if(r.isNotNull()).alias(n) for n, r in named.items()]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(first_of(rules).isNotNull()).alias("violating"), *counts]


def observed(df: DataFrame, rules: list[Column], name: str = "quality", **named: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts rows and violating rows while it is processed, and the rows that break each rule in ``named``, without a further pass.

    ``observation.get`` has the counts once an action on what is made of ``df`` is done.
    """
    o = Observation(name)
    return df.observe(o, *_quality(rules, named)), o


def observed_stream(stream: DataFrame, rules: list[Column], name: str = "quality", **named: Column) -> DataFrame:
    """A stream that counts as ``observed`` does, for each micro-batch; a ``QualityListener`` of the name gathers the counts."""
    return stream.observe(name, *_quality(rules, named))


class QualityListener(StreamingQueryListener):
    """Gathers what streams observed under a name, a dict for each micro-batch with rows, and hands each to ``put``."""

    def __init__(self, name: str = "quality", put: Callable[[dict], None] | None = None):
        self.name, self.put, self.batches = name, put, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["rows"]:
            self.batches.append({"batch": event.progress.batchId, **seen.asDict()})
            if self.put:
                self.put(self.batches[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
