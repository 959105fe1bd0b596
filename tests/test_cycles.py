"""Strongly connected components and shortest cycles against brute force."""

import random

import pytest

from pactum.operators import closure


def brute(edges):
    """{node: component} of nodes on a cycle, and the length of a shortest cycle through each component's least node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def depths(start):
        seen, front, d = {}, {start}, 0
        while front:
            d += 1
            front = {y for x in front for y in out.get(x, ()) if y not in seen}
            seen.update(dict.fromkeys(front, d))
        return seen

    far = {n: depths(n) for n in {x for e in edges for x in e}}
    component = {n: min([n, *(m for m in far[n] if n in far[m])]) for n in far if n in far[n]}
    return component, {c: far[c][c] for c in set(component.values())}


def found(spark, edges, schema="src long, dst long"):
    df = spark.createDataFrame(edges, schema)
    members = closure.components(df)
    return {r["node"]: r["component"] for r in members.collect()}, {r["component"]: (r["length"], r["cycle"]) for r in closure.cycles(df, members).collect()}


def holds(spark, edges):
    component, cycles = found(spark, edges)
    wanted, lengths = brute(edges)
    pairs = closure.reach(spark.createDataFrame(edges, "src long, dst long"))
    members = closure.components_of(pairs)
    other = {r["component"]: (r["length"], r["cycle"]) for r in closure.cycles_of(pairs, members).collect()}
    assert {r["node"]: r["component"] for r in members.collect()} == wanted and {c: n for c, (n, _) in other.items()} == lengths
    assert all(e in set(edges) for _, path in other.values() for e in zip(path, path[1:]))
    assert component == wanted
    assert {c: n for c, (n, _) in cycles.items()} == lengths
    for c, (n, path) in cycles.items():
        assert path[0] == path[-1] == c and len(path) == n + 1 and len(set(path)) == n
        assert all(e in set(edges) for e in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    holds(spark, list({(rng.randrange(n), rng.randrange(n)) for _ in range((30, 45, 70)[seed])}))


def test_cycles_that_touch_and_self_loops(spark):
    # two cycles share a node, a bridge leads to a third, a node loads itself
    holds(spark, [(5, 6), (6, 5), (6, 7), (7, 8), (8, 6), (8, 1), (1, 2), (2, 3), (3, 1), (9, 9), (9, 5), (3, 4)])


def test_no_cycle_and_no_edges(spark):
    assert found(spark, [(1, 2), (2, 3), (1, 3)]) == ({}, {})
    assert found(spark, []) == ({}, {})


def test_names_nulls_and_repeated_edges(spark):
    edges = [("b", "a"), ("a", "b"), ("a", "b"), (None, "a"), ("a", None), ("b", "c")]
    component, cycles = found(spark, edges, "src string, dst string")
    assert component == {"a": "a", "b": "a"} and cycles == {"a": (2, ["a", "b", "a"])}


def test_layers_with_many_paths_stay_small(spark):
    """27 layers of two nodes, all joined: 2 ** 26 simple paths, and one edge back."""
    edges = [(2 * i + a, 2 * i + 2 + b) for i in range(26) for a in (0, 1) for b in (0, 1)]
    assert found(spark, edges) == ({}, {})
    component, cycles = found(spark, [*edges, (53, 0)])
    assert set(component.values()) == {0} and len(component) == 52
    assert cycles[0][0] == 27


def test_large_loops_broadcast_nothing(spark, monkeypatch):
    """Beyond LOOP_ROWS every join of a loop is shuffled, so that its rounds send nothing through the driver."""
    df = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    plan = lambda hint: df.join(hint(df.select("src")), "src")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(closure._dealt(closure.LOOP_ROWS + 1))
    joins = []
    written = closure.written

    def kept(table, *name):
        joins.append(table._jdf.queryExecution().executedPlan().toString())
        return written(table, *name)

    monkeypatch.setattr(closure, "written", kept)
    monkeypatch.setattr(closure, "LOOP_ROWS", 0)
    component, cycles = found(spark, [(5, 6), (6, 7), (7, 5), (7, 8), (8, 9), (9, 9)])
    assert component == {5: 5, 6: 5, 7: 5, 9: 9} and {c: n for c, (n, _) in cycles.items()} == {5: 3, 9: 1}
    assert any("SortMergeJoin" in p for p in joins) and not any("BroadcastHashJoin" in p for p in joins)


def test_doubling_writes_each_pair_once(spark, monkeypatch):
    """A chain of 16, a cycle and edges from and to null: no pair is written in two rounds."""
    edges = [*((i, i + 1) for i in range(16)), (20, 21), (21, 22), (22, 20), (None, 20), (16, None)]
    rows = []
    written = closure.written

    def kept(table, name):
        out = written(table, name)
        if name == "reach":
            rows.extend((r["start"], r["node"]) for r in out.collect())
        return out

    monkeypatch.setattr(closure, "written", kept)
    got = {(r["start"], r["node"]): r["depth"] for r in closure.reach(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(rows) == len(set(rows)) == len(got)
    chain = {(i, j): j - i for i in range(17) for j in range(i + 1, 17)} | {(i, None): 17 - i for i in range(17)}
    loop = {(20 + a, 20 + b): (b - a) % 3 or 3 for a in range(3) for b in range(3)} | {(None, 20 + b): b + 1 for b in range(3)}
    assert got == chain | loop
