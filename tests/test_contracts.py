import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pactum.contracts import Type, abstract, boolean, derive, field, floating, integer, mapping, record, string, tuple_of, vector
from pactum.operators import checks, modes


def failures(df, **types):
    rows = modes.all_violations(df, checks.column_rules(df, **types), "id").collect()
    return sorted((r.id, r.path, r.rule, r.error_class) for r in rows)


def test_integer_bounds_are_inclusive_and_null_passes(spark):
    df = spark.createDataFrame([(1, 0), (2, 150), (3, -1), (4, 151), (5, None)], "id int, age int")
    assert failures(df, age=integer(min=0, max=150)) == [(3, "age", "min", "ValueError"), (4, "age", "max", "ValueError")]


def test_bool_is_no_integer_and_integer_no_float(spark):
    df = spark.createDataFrame([(1, True, 3)], "id int, b boolean, n int")
    assert failures(df, b=integer(), n=floating()) == [(1, "b", "kind", "TypeError"), (1, "n", "kind", "TypeError")]
    assert failures(df, b=boolean(), n=integer()) == []


def test_nan_is_within_any_bounds(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "id int, v double")
    assert failures(df, v=floating(min=0.0, max=1.0)) == [(2, "v", "max", "ValueError")]


@pytest.mark.parametrize("value, ok", [("abc", True), ("abc\n", False), ("xabc", False), ("b", True), ("a|", False)])
def test_pattern_matches_the_whole_value(spark, value, ok):
    df = spark.createDataFrame([(1, value)], "id int, s string")
    assert (failures(df, s=string(pattern="abc|b")) == []) is ok


def test_pattern_classes_are_unicode_and_groups_may_be_named(spark):
    df = spark.createDataFrame([(1, "é٣")], "id int, s string")
    assert failures(df, s=string(pattern=r"(?P<first>\w)\d")) == []


def test_length_counts_code_points_before_the_pattern(spark):
    df = spark.createDataFrame([(1, "𝒳"), (2, "𝒳𝒳𝒳")], "id int, s string")
    assert failures(df, s=string(max_length=2, pattern="𝒳+")) == [(2, "s", "max_length", "ValueError")]


def test_first_bad_element_is_reported_and_null_elements_are(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 9, 8]), (3, [None]), (4, [])], "id int, v array<int>")
    assert failures(df, v=vector(element=integer(max=5), min_length=1)) == [(2, "v[1]", "max", "ValueError"), (3, "v[0]", "kind", "TypeError"), (4, "v", "min_length", "ValueError")]


def test_tuple_arity_and_positions(spark):
    df = spark.createDataFrame([(1, (1.0, -1.0))], "id int, p struct<_1:double,_2:double>")
    assert failures(df, p=tuple_of(floating(min=0.0), floating(min=0.0))) == [(1, "p[1]", "min", "ValueError")]
    assert failures(df, p=tuple_of(floating())) == [(1, "p", "arity", "ValueError")]


def test_map_fields_missing_and_extra_are_sorted(spark):
    df = spark.createDataFrame([(1, {"x": 1, "z": 2, "y2": 3})], "id int, m map<string,int>")
    shape = mapping(fields=(field("x", integer(max=0)), field("b", integer()), field("a", integer()), field("o", integer(), False)), strict=True)
    rows = modes.all_violations(df, checks.column_rules(df, m=shape), "id").collect()
    assert [(r.rule, r.message) for r in rows] == [("missing", "a,b"), ("extra", "y2,z"), ("max", "above 0")]


def test_record_over_rows(spark):
    df = spark.createDataFrame([(1, 4, 2, "q"), (2, None, 7, "q"), (3, 4, 3, "q")], "id int, hidden int, heads int, other string")
    config = record(field("id", integer()), field("hidden", integer()), field("heads", integer(), False), predicate=lambda r: F.pmod(r["hidden"], r["heads"]) == 0)
    rows = modes.all_violations(df, checks.row_rules(df, config), "id").collect()
    assert [(r.id, r.rule) for r in rows] == [(2, "missing"), (3, "predicate")]
    strict = record(field("id", integer()), strict=True)
    assert {r.message for r in modes.all_violations(df, checks.row_rules(df, strict), "id").collect()} == {"heads,hidden,other"}


def test_deriving_only_tightens_while_display_is_the_nearest():
    a = derive("a", integer(), max=150)
    b = derive("b", a, max=200)
    assert b.displayed()["max"] == 200 and b.enforced()["max"] == 150
    assert b() is b and b(max=7).enforced()["max"] == 7


def test_unnamed_base_is_merged_and_attributes_are_checked():
    assert derive("t", integer(max=5), max=9).enforced() == {"max": 9}
    with pytest.raises(TypeError):
        integer(pattern="x")


def test_predicate_rejects_only_false(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, v int")
    maybe = derive("m", integer(), predicate=lambda c: F.when(c == 1, F.lit(None).cast("boolean")).otherwise(c != 2))
    assert failures(df, v=maybe) == [(2, "v", "predicate", "ValueError")]


def test_abstract_accepts_all_and_tuple_predicates_have_no_effect(spark):
    df = spark.createDataFrame([(1, (1,))], "id int, p struct<_1:int>")
    assert failures(df, p=abstract("top")) == []
    assert failures(df, p=derive("t", derive("u", tuple_of(integer())), predicate=lambda c: F.lit(False))) == []


def test_canonical_form_is_inherited_and_overridden():
    email = derive("email", string(), canonical=F.lower)
    assert derive("gmail", email).canonical_form() is F.lower
    assert derive("loud", email, canonical=F.upper).canonical_form() is F.upper
    assert Type("string").canonical_form() is None


def test_dynamic_kinds(spark):
    cases = {"true": "bool", "1": "integer", "1.0": "float", "-7": "integer", "1e3": "float", "12345678901234567890123456789012345678901": "integer", '"7"': "string", "[1]": "vector", "{}": "map", "null": "null", "{": "corrupt"}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.k for r in df.select("j", checks.dynamic_kind(F.col("j")).alias("k")).collect()} == cases


def test_modes_agree(spark):
    df = spark.createDataFrame([(1, 5, "A"), (2, 9, "Z"), (3, 9, "A")], "id int, n int, s string")
    rules = checks.column_rules(df, n=integer(max=6), s=string(pattern="A"))
    assert [r._valid for r in modes.flag(df, rules).orderBy("id").collect()] == [True, False, False]
    assert {r.id: r._violation.rule for r in modes.first_violation(df, rules).collect()} == {2: "max", 3: "max"}
    good, bad = modes.split(df, rules)
    assert good.columns == df.columns and good.count() == 1 and {r.id: len(r._violations) for r in bad.collect()} == {2: 2, 3: 1}
    assert {r.rule: r.n for r in modes.summary(df, rules).collect()} == {"max": 2, "pattern": 1}
    with pytest.raises(PySparkException, match="ValueError n max"):
        modes.asserted(df, rules).collect()
    assert modes.asserted(good, checks.column_rules(good, n=integer(max=6))).count() == 1


def test_observed_counts_without_another_pass(spark):
    df = spark.range(10).withColumn("n", F.col("id"))
    seen, o = modes.observed(df, checks.column_rules(df, n=integer(max=6)), "t")
    seen.collect()
    assert o.get == {"rows": 10, "violating": 3}


def test_valid_rows_are_pushed_to_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = df.filter("l_quantity <= 30").select("l_orderkey")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(l_quantity,30.0)" in plan and "l_comment" not in plan


def test_custom_rule_kinds(spark):
    with pytest.raises(TypeError):
        checks.custom("broken", None)
    checks.custom("not_multiple", lambda c, n: c % n != 0)
    with pytest.raises(ValueError):
        checks.custom("not_multiple", lambda c, n: c)
    df = spark.createDataFrame([(1, 3), (2, 4)], "id int, n int")
    assert [r.id for r in modes.all_violations(df, [checks.custom_rule("not_multiple", F.col("n"), 3, "n")], "id").collect()] == [2]
    with pytest.raises(KeyError):
        checks.custom_rule("unknown", F.col("n"), 1, "n")
