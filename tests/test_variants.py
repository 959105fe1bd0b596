"""Contracts on VARIANT values: the cases of types and records, and equality with typed columns."""

import json

import pytest
from pyspark.sql import functions as F

from pactum.contracts import boolean, derive, field, floating, integer, mapping, record, string, tuple_of, vector
from pactum.operators import checks, modes, variants

AGE = derive("age", integer(), min=0, max=150)
POSITIVE = derive("positive_integer", integer(), min=0)
NAME = string(min_length=3, pattern="[a-z_][a-z0-9_]*")
EVEN = derive("even_natural_number", integer(), min=1, predicate=lambda c: F.pmod(c, F.lit(2)) == 0)
POINT = record(field("x", floating()), field("y", floating()))
NAMED_POINT = record(field("x", floating()), field("y", floating()), field("label", string(), mandatory=False), strict=True)
PAIR = record(field("0", string()), field("1", floating()), strict=True)
ACT = derive("act", string(), predicate=lambda c: c.isin("gelu", "relu", "silu", "tanh", "gelu_new"))
optional = lambda name, t: field(name, t, mandatory=False)
MODEL = record(
    field("model_type", string()), field("vocab_size", integer(min=1)), optional("architectures", vector(element=string())), optional("hidden_size", integer()),
    optional("num_attention_heads", integer()), optional("hidden_act", ACT), optional("id2label", mapping(value=string())), optional("label2id", mapping(value=integer())),
    predicate=lambda r: F.coalesce(F.pmod(r["hidden_size"], r["num_attention_heads"]) == 0, F.lit(True)),
)
BASE = {"model_type": "bert", "vocab_size": 30522, "hidden_size": 768, "num_attention_heads": 12, "hidden_act": "gelu", "architectures": ["A"], "id2label": {"0": "x"}, "label2id": {"x": 0}}

T, V = "TypeError", "ValueError"
CASES = [
    (AGE, "25", []), (AGE, "0", []), (AGE, "-1", [("v", "min", V)]), (AGE, "200", [("v", "max", V)]), (AGE, '"thirty"', [("v", "kind", T)]), (AGE, "true", [("v", "kind", T)]), (AGE, "null", [("v", "kind", T)]),
    (POSITIVE, "3.14", [("v", "kind", T)]), (POSITIVE, "3.0", [("v", "kind", T)]), (POSITIVE, "1e2", [("v", "kind", T)]), (POSITIVE, "92233720368547758070", []), (POSITIVE, "-92233720368547758070", [("v", "min", V)]),
    (NAME, '"alice"', []), (NAME, '"AB"', [("v", "min_length", V), ("v", "pattern", V)]), (NAME, '"no spaces"', [("v", "pattern", V)]), (NAME, "7", [("v", "kind", T)]),
    (EVEN, "4", []), (EVEN, "0", [("v", "min", V)]), (EVEN, "3", [("v", "predicate", V)]), (EVEN, "-2", [("v", "min", V)]),
    (vector(element=integer()), "[1,2,3]", []), (vector(element=integer()), '[1,"oops",3]', [("v[1]", "kind", T)]), (vector(element=integer()), "[1,null]", [("v[1]", "kind", T)]), (vector(element=integer()), "{}", [("v", "kind", T)]),
    (vector(element=integer(), min_length=2), "[1,2]", []), (vector(element=integer(), min_length=2), "[1]", [("v", "min_length", V)]),
    (tuple_of(), '[1,"a",true]', []), (tuple_of(), '{"x":1}', [("v", "kind", T)]),
    (tuple_of(floating(), floating()), "[1.0,2.5]", []), (tuple_of(floating(), floating()), "[1.0]", [("v", "arity", V)]), (tuple_of(floating(), floating()), '[1.0,"a"]', [("v[1]", "kind", T)]), (tuple_of(floating(), floating()), "[1.0,2]", [("v[1]", "kind", T)]),
    (mapping(value=integer()), '{"alice":10}', []), (mapping(value=integer()), '{"alice":"ten"}', [("v.alice", "kind", T)]), (mapping(key=string(pattern="[a-z]+")), '{"A":1}', [("v.A", "pattern", V)]),
    (boolean(), "true", []), (boolean(), "1", [("v", "kind", T)]), (floating(min=0.5), "0.25", [("v", "min", V)]), (floating(), "1", [("v", "kind", T)]),
    (POINT, '{"x":1.0,"y":2.0,"z":3}', []), (POINT, '{"x":1.0}', [("v", "missing", V)]), (POINT, '{"x":1.0,"y":null}', [("v.y", "kind", T)]), (POINT, "[]", [("v", "kind", T)]),
    (NAMED_POINT, '{"x":1.5,"y":2.5,"label":"a"}', []), (NAMED_POINT, '{"x":1.5,"y":2.5}', []), (NAMED_POINT, '{"x":1.5,"y":2.5,"z":1,"a":2}', [("v", "extra", V)]),
    (PAIR, '{"0":"a","1":1.5}', []), (PAIR, '{"0":"a","1":"b","2":0}', [("v", "extra", V), ("v.1", "kind", T)]),
    (MODEL, json.dumps(BASE), []), (MODEL, json.dumps({k: v for k, v in BASE.items() if k != "vocab_size"}), [("v", "missing", V)]), (MODEL, json.dumps(BASE | {"vocab_size": 0}), [("v.vocab_size", "min", V)]),
    (MODEL, json.dumps(BASE | {"hidden_act": "swish"}), [("v.hidden_act", "predicate", V)]), (MODEL, json.dumps(BASE | {"architectures": [42]}), [("v.architectures[0]", "kind", T)]),
    (MODEL, json.dumps(BASE | {"num_attention_heads": 7}), [("v", "predicate", V)]), (MODEL, json.dumps({"model_type": "m", "vocab_size": 5}), []), (MODEL, json.dumps(BASE | {"label2id": {"x": 0.5}}), [("v.label2id.x", "kind", T)]),
    (record(exactly_one=("a", "b")), '{"a":1}', []), (record(exactly_one=("a", "b")), '{"a":1,"b":2}', [("v", "exactly_one", V)]), (record(exactly_one=("a", "b")), '{"a":null}', [("v", "exactly_one", V)]),
    (record(field("a b", record(field("c", vector(element=record(field("d'e", integer(max=1)))))))), '{"a b":{"c":[{"d\'e":1},{"d\'e":2}]}}', [("v.a b.c[1].d'e", "max", V)]),
]


def test_cases_of_types_and_records(spark):
    df = spark.createDataFrame([(i, j) for i, (_, j, _) in enumerate(CASES)], "i int, j string").withColumn("v", F.try_parse_json("j")).persist()
    for i, (t, j, wanted) in enumerate(CASES):
        found = [(r["path"], r["rule"], r["error_class"]) for r in modes.all_violations(df.filter(f"i = {i}"), checks.column_rules(df, v=t)).collect()]
        assert found == wanted, (j, found)


ORDER = record(
    field("id", integer(min=1)),
    field("who", record(field("name", string(min_length=2, pattern="[a-z]+")), field("score", floating(min=0.0, max=1.0), mandatory=False), strict=True)),
    field("tags", vector(element=string(max_length=3), min_length=1), mandatory=False),
    field("parts", vector(element=record(field("n", integer(max=9)), field("ok", boolean()))), mandatory=False),
    predicate=lambda r: r["id"] < 100,
)
TYPED = "id bigint, who struct<name:string,score:double>, tags array<string>, parts array<struct<n:bigint,ok:boolean>>"
ROWS = [
    (1, ("ann", 0.5), ["a"], [(1, True)]), (0, ("A", 2.0), [], [(1, True), (10, True), (11, False)]), (100, ("bo", None), None, None), (None, ("x1", -1.0), ["abcd", "ab"], []),
    (2, None, ["a", "toolong"], [(1, None)]), (3, (None, 0.1), ["a"], None), (500, ("zz", 0.0), ["abc"] * 5, [(99, False)]),
]


def test_a_nested_record_gives_what_the_typed_column_gives(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ROWS)], f"i int, v struct<{TYPED}>")
    # fields that are null are left out of the JSON: absent in both
    other = df.select("i", F.parse_json(F.to_json("v")).alias("v"))
    both = [sorted(map(tuple, modes.all_violations(d, checks.column_rules(d, v=ORDER), "i").collect())) for d in (df, other)]
    assert both[0] == both[1] and len(both[0]) > 12
    first = [sorted((r["i"], r["_violation"]) for r in modes.first_violation(d, checks.column_rules(d, v=ORDER)).collect()) for d in (df, other)]
    assert first[0] == first[1]


def test_variant_fields_of_typed_rows(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, parse_json('{"a":0}')), (2, parse_json('{"a":"0"}')), (3, NULL), (4, parse_json('null')) AS t(i, v)""")
    must = record(field("i", integer()), field("v", record(field("a", integer()))))
    may = record(field("i", integer()), field("v", record(field("a", integer())), mandatory=False))
    found = lambda c: sorted((r["i"], r["path"], r["rule"]) for r in modes.all_violations(df, checks.row_rules(df, c), "i").collect())
    assert found(must) == [(2, "v.a", "kind"), (3, "", "missing"), (4, "v", "kind")]
    assert found(may) == [(2, "v.a", "kind"), (4, "v", "kind")]


def test_json_text_is_checked_as_variant(spark):
    df = spark.createDataFrame([(1, '{"a":0}'), (2, "{"), (3, '{"a":1,"a":2}'), (4, None), (5, "[1]")], "i int, j string")
    rules = variants.json_rules(j=(F.col("j"), record(field("a", integer(max=0)))))
    assert sorted((r["i"], r["path"], r["error_class"]) for r in modes.all_violations(df, rules, "i").collect()) == [(2, "j", "ParseError"), (3, "j", "ParseError"), (5, "j", "TypeError")]


def test_no_cast_and_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "{}")], "i int, j string").withColumn("v", F.try_parse_json("j"))
    modes.all_violations(df, checks.column_rules(df, v=ORDER), "i").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bad", ["1.50", "100.0", "1e2", "9223372036854775807.0"])
def test_numbers_with_a_fraction_or_an_exponent_are_floats(spark, bad):
    kinds = spark.createDataFrame([(bad,), ("9223372036854775808",), ("7",)], "j string").select(variants.kind_of(F.parse_json("j")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["float", "integer", "integer"]


def test_checks_of_documents_are_spread_over_all_cores(spark, sf):
    from pactum.catalog import QUERIES

    df = QUERIES["check_variant_record"](spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
