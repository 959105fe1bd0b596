"""Ranked search, toxicity scores and clusters, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import centroids, lexical, toxicity

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


# --- ranked lexical search ----------------------------------------------------------------------------------


def terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    """item_id, rank, doc_id, score by the stated formulas."""
    kept = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, words, df = len(kept), sum(n for _, _, n in kept), Counter(t for _, c, _ in kept for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, tf, n in kept:
            m = 10 + (90 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, DOCS).repartition(5)
    return sorted(map(tuple, lexical.search(d, spark.createDataFrame(items, ITEMS), **settings).collect()), key=repr)


def some_items(rows, n=30, seed=3):
    rng = random.Random(seed)
    phrases = [" ".join((rng.choice(rows)[1] or "x").split()[:4]) for _ in range(6)]
    return [(i, f"{rng.choice(phrases)}, {rng.choice(phrases)} {rng.choice(rows)[1] or ''}"[: rng.randint(5, 200)]) for i in range(n)]


def test_search_equals_brute_force(spark, rows):
    docs = [(r[0], r[1]) for r in rows]
    items = [*some_items(docs), (90, None), (91, ""), (92, "... !"), (93, "unheardofword"), (None, "long tail"), (94, "LONG"), (94, "one"), (94, "LONG")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_blocks_of_items_give_the_same(spark, rows):
    docs = [(r[0], r[1]) for r in rows]
    items = some_items(docs)
    assert searched(spark, docs, items, block_terms=20) == ranked(docs, items)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in (30, 7, None, 11, 7, -2, 25, 1, 2, 3, 4, 5, 6)]
    got = [r[2] for r in sorted(searched(spark, docs, [(1, "same")]), key=lambda r: r[1])]
    assert got == [-2, 1, 2, 3, 4, 5, 6, 7, 7, 11]
    got = [r[2] for r in sorted(searched(spark, docs[:3], [(1, "same")]), key=lambda r: r[1])]
    assert got == [7, 30, None]


def test_search_in_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "!")], [(1, "a")]) == []


def test_search_among_other_columns(spark, clashing, rows):
    items = [(i, t, "x", 1.0) for i, t in some_items([(r[0], r[1]) for r in rows])]
    got = lexical.search(clashing, spark.createDataFrame(items, "item_id long, text string, item string, block double"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked([(r[0], r[1]) for r in rows], [x[:2] for x in items])


def test_a_text_longer_than_a_run_counts_whole(spark):
    long = "filler words " * (lexical.RUN_BYTES // 6) + "needle"
    docs, items = [(1, long), (2, "needle in a short text"), (3, "filler")], [(1, "needle filler")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_shared_sets_are_summed_once():
    rng = random.Random(5)
    groups = [list(range(10 * g, 10 * g + 10)) for g in range(20)]
    items = [sorted({t for g in rng.sample(groups, 4) for t in g} | {200 + i}) for i in range(60)]
    set_of, pairs, lists = lexical.shared_sets(items)
    parts = [{t} for t in range(max(map(max, items)) + 1)]
    sets = [set().union(*(p for t, p in enumerate(parts) if set_of[t] == s)) for s in range(max(set_of) + 1)]
    for a, b in pairs:
        assert not sets[a] & sets[b]
        sets.append(sets[a] | sets[b])
    assert [set().union(*(sets[n] for n in x)) for x in lists] == list(map(set, items))
    alone = sum(len(x) for x in items)
    assert len(set_of) + len(pairs) + sum(map(len, lists)) < 0.25 * alone


# --- clusters ------------------------------------------------------------------------------------------------


def clustered(vectors, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), x in zip(kept, of) if x == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in last), key=repr)


VECTORS = "vec_id long, embedding array<double>"


def grouped(spark, vectors, schema=VECTORS, **settings):
    return sorted(map(tuple, centroids.cluster_vectors(spark.createDataFrame(vectors, schema).repartition(4), **settings).collect()), key=repr)


def some_vectors(n=150, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dims))
    return [(int(i), (middles[rng.integers(12)] + rng.normal(size=dims) * 0.4).tolist()) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    v = some_vectors()
    v += [(5, v[5][1]), (5, v[6][1]), (None, v[7][1]), (-3, [0.0] * 64), (900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] + [1.0] * 63), (904, [math.inf] * 64), (905, [])]
    assert grouped(spark, v) == clustered(v)


def test_few_or_equal_vectors(spark):
    for v in (some_vectors(3), [(i, [0.5] * 64) for i in range(60)], some_vectors(1)):
        assert grouped(spark, v) == clustered(v)
    assert grouped(spark, []) == []


def test_very_large_components_take_part(spark):
    v = some_vectors(60) + [(1000 + i, [3e6 * (i + 1)] + [0.0] * 63) for i in range(5)]
    assert grouped(spark, v, k=8) == clustered(v, k=8)
    with pytest.raises(Exception, match="range of long"):
        grouped(spark, [*v, (1, [1e300] * 64)])
    with pytest.raises(Exception, match="long|int64|overflow|too big|too large"):
        grouped(spark, [*v, (1, [1e15] * 64), (2, [-1e15] * 64)], k=1)


def test_clusters_among_other_columns(spark):
    v = some_vectors(80)
    got = grouped(spark, [(*x, "a", 1) for x in v], VECTORS + ", cluster string, v int")
    assert got == clustered(v)


def test_bounds_hold_and_leave_centroids_out():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(30, 64)) * 200
    rows = np.rint(middles[rng.integers(30, size=2000)] + rng.normal(size=(2000, 64)) * 20).astype(np.int64)
    simplex = centroids.Simplex(rows[:12])
    ends = np.rint(middles).astype(np.int64)
    low, high = simplex.bounds(simplex.apexes(rows), simplex.apexes(ends))
    true = np.sqrt(((rows[:, None] - ends[None]) ** 2).sum(axis=2))
    assert (low <= true).all() and (true <= high).all()
    cluster, distance, compared = centroids.nearest(rows, simplex.apexes(rows), simplex, ends)
    assert (cluster == true.argmin(axis=1)).all() and (distance == np.rint(true.min(axis=1) ** 2)).all()
    assert compared < 0.5 * true.size


# --- toxicity ------------------------------------------------------------------------------------------------


def spoken(n=700, seed=4):
    """(doc_id, text), {doc_id: toxic}: invented words; toxic texts hold some of ten or, in another language, words of one stem."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "li", "mu", "ren", "sta", "vo", "zi", "tha", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    bad = [f"grr{s}" for s in syllables]
    docs, labels = [], {}
    for i in range(n):
        toxic, other = rng.random() < 0.2, rng.random() < 0.3
        w = [word() for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), "xolno" + word() if other else rng.choice(bad).capitalize() + ",")
        docs.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels[i] = int(toxic) if rng.random() < 0.97 else int(not toxic)
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def scored(spark, docs, labels, **settings):
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    out = toxicity.score_documents(d, spark.createDataFrame(labels, LABELS), **settings)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    return out.collect()


def is_held_out(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = spoken()
    odd = [(None, "grrba grrko you"), (2000, None), (2001, ""), (2002, "\t ..."), (2003, docs[3][1]), (3, docs[3][1]), (2004, "ba ko " * 400_000 + "GRRLI grrmu"), (2005, "ba ko " * 400_000)]
    more = [(i, 1, y) for i, y in labels.items()] + [(5000, 0, 1), (None, 1, 1), (3, 1, None), (2003, None, labels.get(3, 0))]
    return labels, scored(spark, docs + odd, more), docs, more


def test_held_out_labels_are_predicted(toxic):
    labels, got, *_ = toxic
    rows = [(r, labels[r["doc_id"]]) for r in got if r["doc_id"] in labels and r["held_out"]]
    assert len(rows) > 80
    assert sum(r["predicted"] == y for r, y in rows) >= 0.93 * len(rows)
    pairs = [(a["score"], b["score"]) for a, x in rows for b, y in rows if x > y]
    assert sum(p > q for p, q in pairs) >= 0.9 * len(pairs)


def test_every_row_is_scored_and_folds_follow_the_id(toxic):
    _, got, docs, _ = toxic
    assert len(got) == len(docs) + 8
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    of = {r["doc_id"]: r for r in got}
    assert of[None]["predicted"] == 1 and of[2004]["predicted"] == 1  # the words stand at the very end of a long text
    assert {of[i]["predicted"] for i in (2000, 2001, 2002, 2005)} == {0}
    assert len({of[i]["score"] for i in (2000, 2001, 2002)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (3, 2003)}) == 1


def test_held_out_labels_teach_nothing(spark, toxic):
    _, got, docs, more = toxic
    turned = [(i, q, 1 - y if y is not None and is_held_out(i) else y) for i, q, y in more]
    sub = [d for d in docs if d[0] < 300]
    keep = lambda rows: sorted((r["doc_id"], round(r["score"], 12)) for r in rows)
    assert keep(scored(spark, sub, more)) == keep(scored(spark, sub, turned))


def test_toxicity_without_labels_or_documents(spark):
    docs = [(1, "a b"), (None, None)]
    assert {r["score"] for r in scored(spark, docs, [])} == {0.5}
    one = next(i for i in range(9) if not is_held_out(i))
    assert {(r["score"], r["predicted"]) for r in scored(spark, [(one, "a b"), (77, "c")], [(one, 1, 0)])} == {(0.0, 0)}
    assert scored(spark, [], [(1, 1, 1)]) == []


def test_toxicity_among_other_columns(spark, clashing):
    labels = [(i * 3 % 1009, "x", i % 2, 1) for i in range(60)]
    got = toxicity.score_documents(clashing.withColumns({c: F.lit(c) for c in ("toxic", "id", "h", "held_out", "_first", "_labelled")}), spark.createDataFrame(labels, "doc_id long, text string, toxic int, id int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == clashing.count()


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(1)
    n, prior = 200_000, 0.15
    y = rng.random(n) < prior
    toxic, clean = np.array([0.5, 0.4, 0.3, 0.35, 0.02, 0.45]), np.array([0.01, 0.02, 0.01, 0.03, 0.02, 0.02])
    votes = rng.random((n, 6)) < np.where(y[:, None], toxic, clean)
    votes[:, 5] = np.where(rng.random(n) < 0.8, votes[:, 0], votes[:, 5])  # mostly repeats the first
    label = (y ^ (rng.random(n) < 0.03)).astype(float)
    v = votes.astype(float)
    model = toxicity.LabelModel.fit(n, v.T @ v, (v * label[:, None]).mean(axis=0) - v.mean(axis=0) * label.mean(), label.mean())
    assert np.abs(model.toxic[1:4] - toxic[1:4]).max() < 0.06 and np.abs(model.clean[1:4] - clean[1:4]).max() < 0.02
    assert {(0, 5)} <= {(i, j) for i, j, _ in model.correlated} and model.share[0] < 0.75 and model.share[2] > 0.85
    assert model.chance([1, 2]) > model.chance([1]) > model.chance([]) > model.chance([], 0)


def test_mined_words_leave_out_what_only_goes_along(spark):
    rng = random.Random(9)
    rows = [(int(i % 5 == 0), [*{f"w{rng.randrange(60)}" for _ in range(8)}, *(["scold", "after"] if i % 10 == 0 else ["blame"] if i % 5 == 0 else [])]) for i in range(400)]
    got = toxicity.mined(spark.createDataFrame([(y, [w.encode() for w in x]) for y, x in rows], "toxic int, words array<binary>"))
    assert {"blame"} < set(got) and len({"scold", "after"} & set(got)) == 1
