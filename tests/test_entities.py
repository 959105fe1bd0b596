import os

import pytest
from pyspark.sql import functions as F

from pactum.contracts import boolean, field, floating, integer, record, string
from pactum.operators import canonical, checks, closure, labels, modes, refs, registry, text
from pactum.plans import scratch
from pactum.plans.components import components
from pactum.plans.scratch import written
from pactum.sources import files, values


def one(df):
    return df.collect()[0]


def test_parse_target_errors_and_parts(spark):
    cases = {
        "@lexica//models:bert.lr": ("lexica", "models", "bert", ["lr"], None),
        "//pkg:t": (None, "pkg", "t", [], None),
        ":t.f.g": (None, None, "t", ["f", "g"], None),
        "@//:x": ("", "", "x", [], None),
        "": (None, None, None, None, "empty label"),
        "@lexica": (None, None, None, None, "@ without //"),
        "//pkg": (None, None, None, None, "// without :"),
        "x": (None, None, None, None, "no :"),
        "//pkg:": (None, None, None, None, "empty target"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", labels.parse_target(F.col("l")).alias("p"))
    assert {r.l: tuple(r.p) for r in df.collect()} == cases


def test_parse_label(spark):
    cases = {"main|@root//p:t": ("main", "@root//p:t", None), "@r//p:t|x": (None, "@r//p:t|x", None), "x": (None, None, "no separator"), "main|p:t": (None, None, "bad inner label")}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", labels.parse_label(F.col("l")).alias("p"))
    assert {r.l: tuple(r.p) for r in df.collect()} == cases


def test_paths_fold(spark):
    df = spark.createDataFrame([("a/./b//../c",), ("../a",), ("a/..",)], "p string").select("p", labels.folded(F.col("p")).alias("f"))
    assert {r.p: r.f for r in df.collect()} == {"a/./b//../c": "a/c", "../a": None, "a/..": ""}


def test_ref_precedence(spark):
    sha = lambda c: c * 40
    listing = spark.createDataFrame([(sha("a"), "refs/heads/main"), (sha("b"), "refs/tags/v1"), (sha("c"), "refs/tags/v1^{}"), (sha("d"), "refs/heads/both"), (sha("d"), "refs/tags/both"), ("abc1234" + "0" * 33, "refs/heads/x"), ("abc1234" + "1" * 33, "refs/heads/y"), (sha("a"), "refs/heads/again")], "sha string, ref string")
    wants = spark.createDataFrame([(w,) for w in ("main", "v1", "both", "abc1234", "abc12340", "nope", "lo", "aaa", "")], "want string")
    local = spark.createDataFrame([("lo", sha("9"))], "want string, sha string")
    resolved = refs.resolve_refs(wants, listing, local).collect()
    got = {r.want: (r.status, r.sha) for r in resolved}
    listed = refs.candidates(spark.createDataFrame(resolved), listing).collect()
    assert sorted(r.sha for r in listed if r.want == "abc1234") == ["abc1234" + "0" * 33, "abc1234" + "1" * 33]
    assert {r.want: r.n_candidates for r in resolved if r.n_candidates} == {w: sum(r.want == w for r in listed) for w in {r.want for r in listed}}
    assert got["main"] == ("branch", sha("a")) and got["v1"] == ("tag", sha("c")) and got["both"] == ("collision", None)
    assert got["abc1234"] == ("ambiguous", None) and got["abc12340"] == ("prefix", "abc1234" + "0" * 33)
    assert got["nope"] == ("unknown", None) and got["lo"] == ("local", sha("9")) and got["aaa"] == ("prefix", sha("a")) and got[""][0] == "ambiguous"


def test_prefix_join_is_no_nested_loop(spark):
    ids = spark.range(100).select(F.sha1(F.col("id").cast("string")).alias("sha"))
    plan = refs.prefix_matches(ids.select(F.substring("sha", 1, 7).alias("want")), ids)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ref_listings(spark):
    lines = spark.createDataFrame([("aa\trefs/heads/m",), ("junk",), ("bb\trefs/tags/t\tmore",)], "line string")
    assert [tuple(r) for r in refs.parse_ref_listing(lines).collect()] == [("aa", "refs/heads/m"), ("bb", "refs/tags/t\tmore")]
    tracked = spark.createDataFrame([("aa refs/remotes/origin/x",), ("bb refs/remotes/origin/HEAD",), ("cc",)], "line string")
    assert [tuple(r) for r in refs.parse_tracking_refs(tracked).collect()] == [("aa", "refs/heads/x")]


def test_snapshot_matrix(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = refs.snapshot_status(keys, "key", keys.filter("key <> 'c'"), keys.filter("key = 'a'"))
    assert {r.key: r.status for r in got.collect()} == {"a": "hit", "b": "corrupt", "c": "miss"}


def test_references_keep_their_order_and_strip_one_colon(spark):
    df = spark.createDataFrame([(1, [":b", "a", "z", "a"]), (2, [])], "id int, refs array<string>")
    reg = spark.createDataFrame([("a", 10), ("b", 20)], "name string, v int")
    assert [tuple(r) for r in registry.resolve_references(df, "id", "refs", reg, "name", "v").collect()] == [(1, [20, 10, None, 10])]
    looked = registry.lookup_by_name(spark.createDataFrame([("::a",), (":a",)], "l string"), "l", reg, "name")
    assert {r.l: (r.v, r.error) for r in looked.collect()} == {"::a": (None, "no :a; available: a,b"), ":a": (10, None)}
    many = spark.range(300).select(F.format_string("n%03d", "id").alias("name"), "id")
    error = one(registry.lookup_by_name(spark.createDataFrame([("x",)], "l string"), "l", many, "name")).error
    assert error == "no x; available: " + ",".join(f"n{i:03d}" for i in range(300))
    nothing = registry.lookup_by_name(spark.createDataFrame([("x",)], "l string"), "l", many.limit(0), "name")
    assert one(nothing).error == "no x; available: "


def test_references_of_a_wrong_kind(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, refs array<string>")
    reg = spark.createDataFrame([("a", "value"), ("b", "action")], "name string, kind string")
    assert sorted(tuple(r) for r in registry.wrong_kind(df, "id", "refs", reg, "name", "kind", "value").collect()) == [(1, "b", "action"), (1, "c", None)]


def test_first_row_of_each_text(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None)], "id int, text string")
    assert sorted(tuple(r) for r in registry.first_of_each_text(df, "text", "id").collect()) == [(1, "x"), (2, "y"), (4, None)]


def test_last_definition_wins_and_first_seen_stays(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "name string, seq int, v string")
    assert {r.name: (r.seq, r.v) for r in registry.latest_by_name(df, ["name"], "seq").collect()} == {"a": (3, None), "b": (2, "y")}
    assert {r.name: r.seq for r in registry.first_seen(df, ["name"], "seq").collect()} == {"a": 1, "b": 2}


def test_merge_keeps_explicit_nulls_of_the_right_side(spark):
    a = spark.createDataFrame([(1, "k", "x"), (1, "l", "y")], "id int, key string, value string")
    b = spark.createDataFrame([(1, "k", None), (2, "m", "z")], "id int, key string, value string")
    assert {(r.id, r.key): r.value for r in canonical.merge_attributes(a, b, ["id", "key"]).collect()} == {(1, "k"): None, (1, "l"): "y", (2, "m"): "z"}
    m = one(spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>").select(canonical.merged_map(F.col("x"), F.col("y")).alias("m"))).m
    assert m == {"a": 1, "b": 3}


def test_strip_takes_all_white_space(spark):
    assert one(spark.createDataFrame([("\t\u00a0a b\n",)], "s string").select(canonical.stripped(F.col("s")).alias("s"))).s == "a b"


def test_closure_stops_at_cycles_and_goes_deep(spark):
    got = closure.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "x")], "src string, dst string"))
    assert sorted((r.start, r.node, r.depth, r.cycle) for r in got.collect()) == [("a", "a", 2, True), ("a", "b", 1, False), ("b", "a", 1, False), ("b", "b", 2, True), ("x", "x", 1, True)]
    rec = closure.recursive_closure(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), "true")
    assert rec.count() == 4
    assert closure.closure(spark.createDataFrame([], "src string, dst string")).count() == 0
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        closure.closure(spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int"), rounds=3)


def test_reach_gives_each_node_once(spark):
    # three layers of nine nodes, all joined: thousands of simple paths, few pairs; and a ring with a tail
    edges = [(10 * layer + i, 10 * layer + 10 + j) for layer in range(3) for i in range(6) for j in range(6)]
    edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(103, 200), (200, 201), (300, 300)]
    want = {}
    for start in {a for a, _ in edges}:
        front, depth = {start}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and (start, b) not in want}
            want |= {(start, b): depth for b in front}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.start, r.node): r.depth for r in closure.reach(df).collect()} == want
    some = closure.reach(df, spark.createDataFrame([(100,), (0,), (999,)], "start long"))
    assert {(r.start, r.node): r.depth for r in some.collect()} == {k: d for k, d in want.items() if k[0] in (0, 100)}
    assert closure.reach(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(40, 100), (500, 501)]
    got = components(written(spark.createDataFrame(edges, "a long, b long"), "edges"))
    parents = {r.node: r.parent for r in got.collect()}
    assert all(parents[i] == 0 for i in [*range(1, 41), *range(100, 140)]) and parents[501] == 500 and 0 not in parents and 500 not in parents
    assert components(written(spark.createDataFrame([], "a long, b long"), "edges")) is None


def test_symbols_and_loads(spark):
    src = 'load("//l:x", "A",\n "B", c="D")\nX = 1\nX = 2\ndef f(a):\n  Y = 3\nZ == 4'
    df = spark.createDataFrame([("f1", src), ("f2", "")], "file string, text string")
    assert sorted(tuple(r) for r in text.symbol_index(df, "file", "text").collect()) == [("f1", "X", 2), ("f1", "f", 4)]
    assert sorted(tuple(r) for r in text.import_edges(df, "file", "text").collect()) == [("f1", "//l:x", "A"), ("f1", "//l:x", "B")]


def test_edits_refer_to_edited_text(spark):
    rows = [("d", 1, None, None, None, None, "ab\ncd"), ("d", 2, 0, 1, 1, 1, "X\nY"), ("d", 3, 1, 0, 1, 1, "Z"), ("d", 4, 9, 9, 9, 9, "!")]
    df = spark.createDataFrame(rows, "doc string, seq int, start_line int, start_col int, end_line int, end_col int, text string")
    assert one(text.apply_edit_log(df, "doc")).text == "aX\nZd!"


def test_permissive_json_and_listings(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "{"), (3, None), (4, '{"k": "abc"}'), (5, "[1]"), (6, "7"), (7, '{"other": 2}'), (8, '{"k": null}'), (9, '{"k": 1.5}')], "id int, j string")
    good, bad = files.read_permissive(df, "j", "k int")
    assert sorted((r.id, r.parsed.k) for r in good.collect()) == [(1, 1), (7, None)]
    # a null is a value of the wrong kind, an absent field is none
    assert {r.id: r.error_class for r in bad.collect()} == {2: "ParseError", 3: "MissingInput", **dict.fromkeys((4, 5, 6, 8, 9), "TypeError")}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.def").write_text("é")
    (tmp_path / "y.def").write_text("x")
    found = files.list_files(spark, [str(tmp_path), str(tmp_path / "none")], "*.def").collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["x.def", "y.def"]
    assert {r.text for r in files.read_texts(spark, str(tmp_path / "a")).collect()} == {"é"}


def test_reads_hold_the_declared_types(spark, tmp_path):
    at = str(tmp_path / "v")
    spark.createDataFrame([(1, "a", 2.5)], "k int, s string, x float").write.parquet(at)
    value = lambda *fields: values.Value("v", record(*fields), values.Location("posix", {"path": at}))
    read = values.read_value(spark, value(field("k", integer()), field("s", string()), field("x", floating()), field("more", integer(), mandatory=False)))
    assert read.dtypes == [("k", "bigint"), ("s", "string"), ("x", "double"), ("more", "bigint")] and [tuple(r) for r in read.collect()] == [(1, "a", 2.5, None)]
    with pytest.raises(TypeError, match="no column 'lost'"):
        values.read_value(spark, value(field("k", integer()), field("lost", string())))
    for wrong in (field("s", integer()), field("x", integer()), field("k", string()), field("k", boolean())):
        with pytest.raises(TypeError, match="declared is"):
            values.read_value(spark, value(wrong))


def test_defaults_and_exactly_one(spark):
    contract = record(field("a", integer(), default=7), field("b", integer(), mandatory=False), field("c", string(), default="x"), exactly_one=("a", "b", "lacking"))
    df = spark.createDataFrame([(1, None), (None, None), (None, 2), (3, 4)], "a long, b long")
    assert [tuple(r) for r in canonical.with_defaults(df, contract).collect()] == [(1, None, "x"), (7, None, "x"), (7, 2, "x"), (3, 4, "x")]
    got = modes.all_violations(df, checks.row_rules(df, contract), "a", "b").collect()
    assert {(r.a, r.b): (r.rule, r.message) for r in got} == {(None, None): ("exactly_one", ""), (3, 4): ("exactly_one", "a,b")}


def test_location_predicates(spark):
    df = spark.createDataFrame([("s3", "b", "p/x"), ("s3", "b", "q"), ("s3", None, "p"), ("posix", "b", "p")], "kind string, bucket string, prefix string")
    differs = values.location_violation({"bucket": F.col("bucket"), "prefix": F.col("prefix")}, F.col("kind"), values.Location("s3", {"bucket": "b"}), lambda a: a["prefix"].startswith("p"))
    assert [r.d for r in df.select(differs.alias("d")).collect()] == [None, "predicate", "bucket", "kind"]


def test_named_groups(spark):
    df = spark.createDataFrame([("1.2",), ("1",), ("x",), (None,)], "v string")
    got = df.select(text.named_groups(F.col("v"), r"\A(\d+)(?:\.(\d+))?\z", "major", "minor").alias("g")).collect()
    assert [r.g and tuple(r.g) for r in got] == [("1", "2"), ("1", ""), None, None]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_dir(Cluster())


def test_broadcasts_are_measured_in_bytes(spark):
    long = written(spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("abc")).alias("a")), "long")
    assert 50_000 < scratch.table_bytes(long) < 60_000
    assert "broadcast" in scratch.small(long)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in scratch.small(long, 10_000)._jdf.queryExecution().logical().toString().lower()


def test_a_scope_deletes_what_it_wrote(spark):
    outer = written(spark.range(3), "outer")
    with scratch.scope():
        inner = written(outer, "inner")
        assert inner.count() == 3
    assert outer.count() == 3 and not os.path.exists(inner._scratch_path.removeprefix("file://"))


def test_locations():
    assert values.Location("s3", {"bucket": "b", "prefix": "/p"}).uri() == "s3a://b/p"
    assert values.Location("posix", {"path": "/x"}).uri() == "/x"


def test_prefixes_offer_only_lengths_that_can_match(spark, monkeypatch):
    """Names that no id begins with make no keys; lengths with few requests are broadcast, so of ids only distinct ones are shuffled."""
    ids = spark.createDataFrame([("abcdef",), ("abcxyz",), ("b",), (None,), ("abcdef",)], "sha string")
    wants = spark.createDataFrame([("",), ("a",), ("ab",), ("abcd",), ("abcdefg",), ("b",), ("bc",), ("v1",), ("none23",), (None,)], "want string")
    right = [("", "abcdef"), ("", "abcxyz"), ("", "b"), ("a", "abcdef"), ("a", "abcxyz"), ("ab", "abcdef"), ("ab", "abcxyz"), ("abcd", "abcdef"), ("b", "b")]
    found = refs.prefix_matches(wants, ids)
    assert sorted(map(tuple, found.collect())) == right
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_sha#" in plan and ", 1, 6)" not in plan and ", 1, 4)" in plan
    # by both ways, a length with many requests and the others
    monkeypatch.setattr(refs, "FEW", 3)
    assert sorted(map(tuple, refs.prefix_matches(wants, ids).collect())) == right
    monkeypatch.setattr(refs, "FEW", 0)
    assert sorted(map(tuple, refs.prefix_matches(wants, ids).collect())) == right
    assert refs.prefix_matches(wants.filter("want = 'v1'"), ids).collect() == []


def test_identifiers_are_counted_where_their_text_lies(spark):
    """Texts with a key are shuffled once, before their tokens are made; rows of one key or of none count together."""
    df = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, "1 2"), (None, "x a"), (None, "a")], "id long, t string")
    found = text.identifier_counts(df, "id", "t")
    assert {tuple(r) for r in found.collect()} == {(1, "a", 2, 0), (1, "b", 2, 0), (1, "c", 1, 1), (None, "x", 1, 0), (None, "a", 2, 0)}
    plan = text.identifier_counts(df.filter("id is not null"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_lineage_reads_its_source_once(spark):
    df = spark.createDataFrame([(1, [5, 6], [9]), (2, None, [8]), (3, [], [None])], "k int, ins array<int>, outs array<long>")
    found = registry.lineage_edges(df.groupBy("k").agg(F.first("ins").alias("ins"), F.first("outs").alias("outs")), F.col("k").cast("string"), input="ins", output="outs")
    assert {tuple(r) for r in found.collect()} == {("1", "input", 0, 5), ("1", "input", 1, 6), ("1", "output", 0, 9), ("2", "output", 0, 8), ("3", "output", 0, None)}
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "int", "bigint"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_workspaces_resolve_their_requests_once(spark, sf, monkeypatch):
    """The result reads written tables alone; no prefix of an id is searched for again in one of its uses."""
    from pactum.catalog import QUERIES

    plan = QUERIES["workspace_for_label"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "sha1" not in plan
