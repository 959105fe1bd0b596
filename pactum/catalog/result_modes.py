"""What becomes of violations, over lineitem, orders and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.contracts import floating, integer, string
from pactum.operators import checks, modes
from pactum.plans.scratch import written

LINE = ["l_orderkey", "l_linenumber"]


def line_rules(df):
    return checks.column_rules(df, l_linenumber=integer(min=1, max=7), l_quantity=floating(max=30.0), l_discount=floating(min=0.02), l_returnflag=string(pattern="A|N"))


_ALL = """SELECT l_orderkey, l_linenumber, 'l_quantity' AS path, 'max' AS rule, 2 AS k FROM lineitem WHERE l_quantity > 30
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'min', 3 FROM lineitem WHERE l_discount < 0.02
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', 'pattern', 4 FROM lineitem WHERE NOT regexp_full_match(l_returnflag, 'A|N')"""


@query("SELECT l_orderkey, l_linenumber, NOT (l_quantity > 30 OR l_discount < 0.02 OR l_returnflag NOT IN ('A', 'N')) AS _valid FROM lineitem")
def mode_flag(t):
    return modes.flag(t.lineitem, line_rules(t.lineitem)).select(*LINE, "_valid")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'l_quantity' WHEN l_discount < 0.02 THEN 'l_discount' ELSE 'l_returnflag' END AS path FROM lineitem
 WHERE l_quantity > 30 OR l_discount < 0.02 OR l_returnflag NOT IN ('A', 'N')""")
def mode_first_violation(t):
    return modes.first_violation(t.lineitem, line_rules(t.lineitem)).select(*LINE, F.col("_violation.path").alias("path"))


@query(f"SELECT l_orderkey, l_linenumber, path, rule FROM ({_ALL})")
def mode_all_violations(t):
    return modes.all_violations(t.lineitem, line_rules(t.lineitem), *LINE).select(*LINE, "path", "rule")


@query("""SELECT o_orderkey, 'valid' AS part, 0::INT AS n FROM orders WHERE o_totalprice <= 200000 AND o_orderstatus IN ('F', 'O')
 UNION ALL SELECT o_orderkey, 'quarantine', (o_totalprice > 200000)::INT + (o_orderstatus NOT IN ('F', 'O'))::INT FROM orders WHERE o_totalprice > 200000 OR o_orderstatus NOT IN ('F', 'O')""")
def mode_split(t):
    good, bad = modes.split_written(t.orders, checks.column_rules(t.orders, o_totalprice=floating(max=200000.0), o_orderstatus=string(pattern="[FO]")))
    return good.select("o_orderkey", F.lit("valid").alias("part"), F.lit(0).alias("n")).unionByName(bad.select("o_orderkey", F.lit("quarantine").alias("part"), F.size("_violations").alias("n")))


@query("SELECT p_partkey FROM part")
def mode_assert(t):
    return modes.asserted(t.part, checks.column_rules(t.part, p_size=integer(min=1), p_brand=string(pattern=r"Brand#\d+"))).select("p_partkey")


@query(f"SELECT path, rule, CASE WHEN false THEN '' ELSE 'ValueError' END AS error_class, count(*)::BIGINT AS n FROM ({_ALL}) GROUP BY path, rule")
def violation_summary(t):
    return modes.summary(t.lineitem, line_rules(t.lineitem))


@query("""SELECT count(*)::BIGINT AS n_failed, count(*)::VARCHAR || ' failed' || CASE WHEN count(*) > 0 THEN chr(10) ELSE '' END || coalesce(string_agg(line, chr(10) ORDER BY line), '') AS report
 FROM (SELECT event_type || ': ' || count(*)::VARCHAR AS line FROM events WHERE value > 100 GROUP BY event_type)""")
def failure_report(t):
    df = t.events
    found = modes.all_violations(df, checks.column_rules(df, value=floating(max=100.0)), "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return modes.report(found, F.concat("event_type", F.lit(": "), F.col("n").cast("string")))


@query("""SELECT l_returnflag, sum(l_quantity) AS quantity, (SELECT count(*) FROM lineitem)::BIGINT AS rows,
 (SELECT count(*) FROM lineitem WHERE l_quantity > 30 OR l_discount < 0.02 OR l_returnflag NOT IN ('A', 'N'))::BIGINT AS violating,
 (SELECT count(*) FROM lineitem WHERE l_quantity > 30)::BIGINT AS quantity_max, (SELECT count(*) FROM lineitem WHERE l_discount < 0.02)::BIGINT AS discount_min FROM lineitem GROUP BY l_returnflag""")
def observe_quality(t):
    """The sums are written, and the counts that this pass observed come with them, in all and for two of the rules."""
    rules = line_rules(t.lineitem)
    named = {"quantity_max": checks.column_rules(t.lineitem, l_quantity=floating(max=30.0))[0], "discount_min": checks.column_rules(t.lineitem, l_discount=floating(min=0.02))[0]}
    df, seen = modes.observed(t.lineitem, rules, f"quality-{uuid.uuid4().hex}", **named)
    sums = written(df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity")), "sums")
    return sums.withColumns({k: F.lit(v).cast("long") for k, v in seen.get.items()})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax * 100 % 2 > 0.5 AND l_tax * 100 % 2 < 1.5")
def register_check_kind(t):
    if "even_percent" not in checks._CUSTOM:
        checks.custom("even_percent", lambda c, step: (c * 100 % step > step / 4) & (c * 100 % step < step * 3 / 4))
    df = t.lineitem
    return modes.first_violation(df, [checks.custom_rule("even_percent", F.col("l_tax"), 2, "l_tax")]).select(*LINE)
