"""Packing, near-duplicates, id files, top-k, language model: brute force, round trips, awkward rows."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.llm import idcoder, idfiles, neardup, packing, textbytes, tokens, topk, toxicity, treeweight


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def plain_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")


# --- tokens and packing ---


def test_word_by_word_ids_equal_whole_text_ids(rows, plain_ids):
    enc = tokens.encoder(tokens.default_tokenizer())
    for text in [r[1] for r in rows] + ["Hi. a,b c... x.y É. é, ß. » a.\x85b. 'tis it's. U.S.A. 3.14, e.́ <|X|> <|endoftext|>. A.", "İ. K, ǅ."]:
        assert [*enc.encode(text).tolist(), 1] == plain_ids(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbé.,!'́ \n\t<|>\x85\xa01ßİ»"), max_size=60))
def test_word_by_word_ids_on_any_text(text):
    enc = tokens.encoder(tokens.default_tokenizer())
    assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece_once(docs, rows, plain_ids):
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in rows:
        ids = plain_ids(r[1])
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[(r[0], p, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(by) == math.ceil(sum(k[3] * n for k, n in want.items()) / 4096)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=7))
def test_plans_are_whole_and_near_the_bound(counts):
    rows, proven = packing.plan(counts, 20)
    used = Counter()
    for filling, n in rows:
        assert sum(a * c for a, c in filling) <= 20
        for a, c in filling:
            used[a] += c * n
    assert used == Counter(counts)
    lengths = packing._Lengths(counts)
    assert sum(n for _, n in rows) <= sum(n for _, n in packing._decreasing(lengths, 20))
    if proven:
        assert sum(n for _, n in rows) == fewest_bins(counts, 20)


def test_most_small_plans_are_proven_best():
    rng, proven = random.Random(2), 0
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        rows, sure = packing.plan(counts, 20)
        proven += sure
        assert sum(n for _, n in rows) == fewest_bins(counts, 20)
    assert proven == 200


def test_bin_completion_beats_best_fit():
    counts = Counter([6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2])  # 50 in 5 bins of 10
    lengths = packing._Lengths(counts)
    assert bins(counts, 10) == 5 <= sum(n for _, n in packing._decreasing(lengths, 10))


def test_packing_odd_rows(clashing, empty, docs):
    assert packing.pack_documents(empty).count() == 0
    assert Counter(packing.pack_documents(clashing).drop("sequence_id", "offset").collect()) == Counter(packing.pack_documents(docs).drop("sequence_id", "offset").collect())


# --- near duplicates ---


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(docs, rows, size):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size).collect())
    assert got == Counter(brute_components(rows, size, 80))


def test_chains_and_hot_groups(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"v{i}"])) for i in range(300)]  # all near each other
    step = list(base)
    for i in range(12):  # a chain: neighbours are near, the ends are not
        step = step[5:] + [f"n{i}x{k}" for k in range(5)]
        rows.append((1000 + i, " ".join(step)))
    rng.shuffle(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == Counter(brute_components(rows, 2, 80))


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    a = textbytes.splitmix(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    far = np.bitwise_count((neardup.odd_sketch(neardup.minhash(a)) ^ neardup.odd_sketch(neardup.minhash(textbytes.splitmix(a)))).view(np.uint64)).sum()
    b = np.unique(np.concatenate([a[:890], textbytes.splitmix(a[:110])]))  # similarity 0.8
    near = np.bitwise_count((neardup.odd_sketch(neardup.minhash(np.unique(a))) ^ neardup.odd_sketch(neardup.minhash(b))).view(np.uint64)).sum()
    assert near <= neardup._least_differing(80) < far


def test_links_between_members_that_differ_from_their_pivot(spark, monkeypatch):
    """Many near copies of one text, some of which share changes: links that no pivot takes part in are found too."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]

    def changed(words_, share):
        return [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in words_]

    branches = [changed(base, 0.12) for _ in range(8)]
    texts = [changed(base, rng.choice([0.01, 0.03, 0.05, 0.08])) for _ in range(60)] + [changed(rng.choice(branches), rng.choice([0.0, 0.01, 0.03])) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {d: c for d, _, c in brute_components(rows, 2, 80)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()} == want
    monkeypatch.setattr(neardup, "_crossing", lambda stars, sets, percent, parents: parents)
    without = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert without != want and 1 < len(set(want.values())) < len(set(without.values()))


def test_members_meet_where_their_needs_allow_it(spark):
    rng = random.Random(5)
    rows = [(p, sh, p * 10000 + k, 20 * rng.choice([rng.randrange(-40, 900), 77]), rng.randrange(60)) for p in range(2) for sh in range(3) for k in range([5, 9, 300][sh])]
    df = spark.createDataFrame(rows, "pivot long, shingle long, node long, need long, after int").withColumn("part", F.col("node"))
    df = df.join(df.groupBy("pivot", "shingle").agg(F.count("*").alias("n"), F.min("need").alias("low"), F.max("need").alias("high")), ["pivot", "shingle"])
    want = set()
    for p, sh, x, need, after in rows:
        most = 360 * (1 + after) - need
        want |= {(sh, x, y) for q, t, y, other, _ in rows if (q, t) == (p, sh) and (need, x) < (other, y) and other <= most}
    got = [(r.shingle, r.node, r._node) for r in neardup._within(df, df, 80).select("shingle", "node", "_node").collect()]
    few = [g for g in got if g[0] == 0]
    assert len(got) == len(set(got)) and {g for g in got if g[0]} == {w for w in want if w[0]}
    assert {w for w in want if not w[0]} <= set(few) and len(few) <= 2 * 10


def test_rows_of_a_step_grow_with_members_of_a_group(spark, monkeypatch):
    """One row for each member and two ends for each that another may suit, in small groups and in large ones."""
    made, write = [], neardup.written

    def counted(df, name):
        out = write(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    each = []
    for members in (8, 40):
        rows = [(p, 1, p * 100 + k, p * 100 + k, 20 * k * k, 10, members, 0, 20 * members**2) for p in range(5) for k in range(members)]
        df = spark.createDataFrame(rows, "pivot long, shingle long, node long, part long, need long, after int, n long, low long, high long")
        met = neardup._within(df, df, 80).count()
        want = sum(20 * j * j + 20 * k * k <= 360 * 11 for k in range(members) for j in range(k + 1, members))
        assert met == 5 * want and want
        each.append(sum(made) / len(rows))
        made.clear()
    assert 1 < each[1] <= each[0] <= 3, each


def test_pages_of_one_template_meet_where_needs_allow_it(spark, monkeypatch):
    rng = random.Random(6)
    template = [f"t{k}" for k in range(150)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(rng.randint(15, 60))])) for i in range(600)]
    rows += [(1000 + i, rows[rng.randrange(600)][1] + f" end{i}") for i in range(60)]
    met, within = [], neardup._within

    def counted(x, y, percent):
        out = within(x, y, percent)
        other = y.select("pivot", "shingle", F.col("node").alias("_node"))
        every = x.join(other, ["pivot", "shingle"]).filter("node <> _node").count()
        may = out.filter(360 * (1 + F.least("after", "_after")) >= F.col("need") + F.col("_need"))
        met.append((every, out.count(), may.count()))
        return out

    monkeypatch.setattr(neardup, "_within", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 2, 80)}
    # no rows but those that the two needs allow: a fraction of all pairs at a shingle
    assert met and all(rows <= 1.5 * may and 3 * rows <= every for every, rows, may in met), met


def test_one_of_each_group_stays(docs, clashing, empty, rows):
    want = {d for d, n, c in brute_components(rows, 5, 80) if d == c and d is not None} | {r[0] for r in rows if r[0] is not None and not words(r[1])}
    out = neardup.deduplicated(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    # rows of one id stay if their texts differ
    assert Counter(ids) == Counter(d for d, _ in {(r[0], r[1]) for r in rows if r[0] in want})
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_rows_without_an_id_stay_for_themselves(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(5, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (5, text(1)), (6, text(3)), (3, text(3)), (None, None), (None, "")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(5, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (None, None), (None, "")])


# --- toxicity ---


def test_new_words_are_worked_out_together_as_one_by_one(monkeypatch):
    rng = random.Random(12)
    texts = [{"".join(rng.choice("aeé日nrs") for _ in range(rng.randrange(12))).encode() for _ in range(40)} | {b"hateful", b"soooo", b"idiot", b"w" * 300} for _ in range(6)]
    every = set().union(*texts)
    order, rows = toxicity.bucket_rows([w for w in every if len(w) <= toxicity.SHORT_WORD])
    assert [sorted(b for b in column if b >= 0) for column in rows.T.tolist()] == [sorted(toxicity.buckets_of(w)) for w in order]
    voters = toxicity.Voters(["hate*", "aeé", "nrs*"])
    weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS + len(voters) + 1)
    alone, together = (toxicity.Scorer(voters, weights) for _ in range(2))
    want = [alone(t, 0) for t in texts]
    one_by_one = []
    monkeypatch.setattr(toxicity, "buckets_of", lambda w, of=toxicity.buckets_of: one_by_one.append(w) or of(w))
    together.learn(texts)
    assert np.allclose([together(t, 0) for t in texts], want, rtol=0, atol=1e-12) and one_by_one == [b"w" * 300]
    broken = {b"aaaa\xff\xfeaa", b"aaaa"}
    together.learn([broken])
    assert together(broken, 0) == alone(broken, 0)


# --- id files ---


def test_letters_and_signs_have_the_ids_of_the_whole_text(monkeypatch):
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    rng = random.Random(7)
    texts = ["".join(rng.choice("abßé÷øÿÉ'.,!-<|>`~$^_ 1µªst") for _ in range(rng.randrange(40))) for _ in range(400)] + ["<|endoftext|> a<|startoftext|>", "it's l'été don't' x!?", None, ""]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [enc.encode(t).tolist() for t in texts] == want
    # words of letters, with signs or without, are not sent through the tokenizer's scan of texts
    scanned = []
    monkeypatch.setattr(enc, "_together", lambda new: scanned.extend(new) or [])
    enc.clear()
    enc.encode("never örtlich seen%%% before,*** straße.$$$")
    assert not scanned


def test_known_short_words_are_found_together(plain_ids, monkeypatch):
    enc, rng = tokens.WordEncoder(tokens.default_tokenizer()), random.Random(3)
    texts = [" ".join("".join(rng.choice("ab\0é.,$") for _ in range(rng.randrange(1, 20))) for _ in range(3000)) for _ in range(3)]
    texts += ["a a\0 a\0\0 \0 " + " ".join("x" * k + c for k in range(1, 40) for c in ("", ".", "\0", "y."))]
    want = [plain_ids(t)[:-1].tolist() for t in texts]
    assert [enc.encode(t).tolist() for t in texts] == want
    # words seen before have their numbers, and only long ones are kept by their bytes
    assert enc.long and min(map(len, enc.long)) > tokens.SHORT_BYTES
    monkeypatch.setattr(enc, "_learn", None)
    assert [enc.encode(t).tolist() for t in texts] == want


def test_capital_letters_with_accents(plain_ids, monkeypatch):
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    texts = ["Été, ÜBER ÀÞ.$ Ä. Aé×É ÉA", "<|x Éa. ÉA abcÉ<|endoftext|> É<| AÉ", "É\u0301 e\u0301É \u212bé"]
    assert [enc.encode(t).tolist() for t in texts] == [plain_ids(t)[:-1].tolist() for t in texts]
    enc.clear()
    scanned = []
    monkeypatch.setattr(enc, "_together", lambda new: scanned.extend(new) or [[]] * len(new))
    enc.encode("Élan ÜBER$ ÀÞþ")
    assert not scanned


def test_halves_that_share_places():
    low, high = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(40), np.arange(1, 41)))
    table = tokens._Halves(2)
    for part in np.array_split(np.arange(1600), 7):
        assert (table.find(low[part], high[part]) == -1).all()
        table.add(low[part], high[part], part)
    assert table.find(low, high).tolist() == list(range(1600)) and table.find(low, high + np.uint64(40)).max() == -1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65534), max_size=300), st.sampled_from([1, 7, 64, 2048]))
def test_coder_round_trip(ids, block):
    x = np.array(ids, np.uint32)
    order0, blocks, crcs = idcoder.encode(x, block)
    assert idcoder.decode(order0, blocks, crcs, len(x), block).tolist() == ids


def test_coder_learns_and_checks():
    x = np.tile(np.arange(50, dtype=np.uint32), 400)
    order0, blocks, crcs = idcoder.encode(x)
    assert sum(map(len, blocks)) < len(x) / 3
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode(order0, blocks, [c ^ 1 for c in crcs], len(x))
    with pytest.raises(ValueError):
        idcoder.encode(np.array([65535], np.uint32))


def test_coded_ids_take_fewer_bits_than_deflate(sf):
    """Order 0 takes part: fewer bits an id than deflate and than the entropy of the ids' frequencies."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids, ends = tokens.encoder(tokens.default_tokenizer()).encode_all(texts)
    ids = np.insert(ids, ends, tokens.END_ID)
    order0, blocks, crcs = idcoder.encode(ids)
    bits = 8 * (len(order0) + sum(map(len, blocks))) / len(ids)
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) and bits < -(share * np.log2(share)).sum()
    assert (idcoder.decode(order0, blocks, crcs, len(ids)) == ids).all()
    # a block is decoded without any other
    assert (idcoder.decode(order0, blocks[3:5], crcs[3:5], 2 * idcoder.BLOCK_IDS) == ids[3 * idcoder.BLOCK_IDS : 5 * idcoder.BLOCK_IDS]).all()


def test_ids_of_other_tokenizers_are_those_of_whole_texts(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = tokens.WordEncoder(path), Tokenizer.from_file(path)
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 5000]
    ids, ends = enc.encode_all(texts)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not enc.by_words and ids.tolist() == [i for w in want for i in w] and np.diff(ends, prepend=0).tolist() == [len(w) for w in want]


def test_ids_of_a_text_of_several_runs(plain_ids):
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    text = "Some words, with stops. And \u00e4.\n" * 60_000 + "x" * (2 * tokens.RUN_BYTES) + " end."
    ids, ends = enc.encode_all(["one. two", text, None, "three.", " \n"])
    assert enc.by_words and np.diff(ends, prepend=0).tolist() == [len(plain_ids(t)) - 1 for t in ("one. two", text, None, "three.", " \n")]
    assert (ids[ends[0] : ends[1]] == plain_ids(text)[:-1]).all()


def test_many_short_documents_take_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        files = idfiles.written_ids(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1))
        took.append(time.perf_counter() - began)
        assert files.agg(F.sum("n_ids")).first()[0] == n
    assert took[1] < 4 * took[0] + 5


def test_ids_come_back_in_order(docs, rows, plain_ids):
    got = sorted(idfiles.read_ids(idfiles.written_ids(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = Counter((r[0], len(plain_ids(r[1])), zlib.crc32(plain_ids(r[1]).tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_no_segment_but_a_whole_task_is_short(monkeypatch, rows, plain_ids):
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 4})()))
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 500)
    monkeypatch.setattr(idcoder, "LANES", 3)
    texts = [r[1] for r in rows[:60]]
    sizes = np.cumsum([len(plain_ids(t)) for t in texts])
    for n in (1, 2, 40, 45, 50, 55, 60):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts[:n], pa.string())], names=["doc_id", "text"])
        got = [x for b in idfiles._encode(tokens.default_tokenizer())(iter([batch])) for x in b.to_pylist()]
        assert [d for x in got for d in x["doc_ids"]] == list(range(n)) and [x["segment"] for x in got] == list(range(len(got)))
        assert sum(x["n_ids"] for x in got) == sizes[n - 1] and (len(got) == 1 or min(x["n_ids"] for x in got) >= 500)
        back = [r for x in idfiles._decode(iter([pa.RecordBatch.from_pylist(got)])) for r in x.to_pylist()]
        assert [r["ids_crc32"] for r in back] == [zlib.crc32(plain_ids(t).tobytes()) for t in texts[:n]]
    assert len(got) > 1


def test_id_files_odd_rows(empty, clashing, docs):
    assert idfiles.read_ids(idfiles.written_ids(empty)).count() == 0
    assert Counter(idfiles.read_ids(idfiles.written_ids(clashing)).collect()) == Counter(idfiles.read_ids(idfiles.written_ids(docs)).collect())


# --- top-k ---


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.004, 0.25, 1.0, 3.7]) for _ in range(6)], 0) for i in range(150)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (202, [float("nan")] * 6, 0), (250, [float("inf")] * 6, 0), (203, [], 0), (50, rows[50][1], 0), (100, [1.0, -1.0, 0.25, 3.7, 0.0, -0.5], 0), (204, [1e12] * 6, 0), (205, [600_000.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    q = [(i, [math.floor(256 * np.float32(x).astype(float)) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for i, v in {(i, tuple(v)) for i, v in q if i % 50 == 0}:
        others = q.copy()
        others.remove((i, list(v)))  # its own row, and no other
        best = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, w in others)[:5]
        want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    # 50 stands there twice and is asked once; 100 has two vectors, ranked each for itself
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want and len(want) == 20
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_block_scores_are_exact():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (777, 9))
    block, q = topk.SlicedBlock.of(rows), rng.integers(-300, 300, 9)
    found, score = block.top(q, 10, block.everything())
    exact = rows @ q
    assert (exact[found] == score).all() and set(np.argsort(-exact, kind="stable")[:10]) <= set(found)
    zero = block.top(np.zeros(9, np.int64), 3, block.everything())
    assert len(zero[0]) == 777 and not zero[1].any()


# --- language model ---


def brute_ctw(train, text):
    """Context-tree weighting over depths 0, 1, 2, written out one bit at a time."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(3)]

    def bits(data):
        padded = b"\0\0" + data
        for i, byte in enumerate(data):
            last, before = padded[i + 1], padded[i]
            node = 1
            for k in range(8):
                bit = byte >> (7 - k) & 1
                yield ((), (last,), (last, before)), node, bit
                node = node << 1 | bit

    for t in train:
        for contexts, node, bit in bits(t.encode()):
            for d, c in enumerate(contexts):
                counts[d][(c, node)][bit] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)

    children = [defaultdict(float), defaultdict(float)]
    for (c, node), n in counts[2].items():
        children[1][(c[:1], node)] += kt(n)
    weighted = {}
    for (c, node), n in counts[1].items():
        weighted[(c, node)] = np.logaddexp(kt(n), children[1][(c, node)]) - math.log(2)
        children[0][((), node)] += weighted[(c, node)]
    one = lambda n: (n[1] + 0.5) / (n[0] + n[1] + 1)
    total = 0.0
    for contexts, node, bit in bits(text.encode()):
        p = one(counts[2].get((contexts[2], node), (0, 0)))
        for d in (1, 0):
            n = counts[d].get((contexts[d], node), (0, 0))
            share = 1 / (1 + math.exp(min(700, max(-700, children[d].get((contexts[d], node), 0.0) - kt(n)))))
            p = share * one(n) + (1 - share) * p
        total += math.log10(p if bit else 1 - p)
    return total


def test_scores_equal_brute_force(docs, rows):
    rows = [r for r in rows if r[0] != 5005]  # the long one is slow bit by bit
    got = sorted(treeweight.score_documents(docs.filter("doc_id is null or doc_id <> 5005")).collect(), key=str)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    train = [r[1] or "" for r in rows if not held(r[0])]
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*words(r[1]), None]
        want.append((r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), r[1] or ""))
    key = lambda t: (str(t[0]), t[2])
    for g, x in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5] and g[5] == pytest.approx(x[5], rel=1e-9)
        assert g[6] == pytest.approx(brute_ctw(train, x[6]), rel=1e-4, abs=1e-6)
        size = len(x[6].encode())
        assert g[7] == (pytest.approx(-g[6] * math.log2(10) / size) if size else None)


def test_values_by_open_addresses():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 5000):
        item = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), np.arange(n // 2) << 40, [0][: n % 2]]).astype(np.int64))
        rng.shuffle(item)
        values = treeweight._Values(item, np.arange(len(item), dtype=float))
        ask = item[rng.integers(0, len(item), 3 * n)] if n else item
        assert (values[ask] == [{x: k for k, x in enumerate(item.tolist())}[x] for x in ask.tolist()]).all()


def test_deeper_contexts_shorten_the_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bits = {}
    for depth in (2, 5):
        scored = treeweight.score_documents(docs, depth=depth).filter("held_out and code_length_per_byte is not null")
        bits[depth] = scored.agg(F.sum(-F.col("score")) / F.sum(-F.col("score") * math.log(10) / math.log(2) / F.col("code_length_per_byte")) * math.log2(10)).first()[0]
    assert 0 < bits[5] < bits[2]


def test_model_predicts_held_out_text(docs, empty, clashing):
    got = treeweight.score_documents(docs).filter("held_out and n_tokens > 20").join(docs.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").collect()
    assert got and all(-r.score * math.log2(10) / r.bytes < 6 for r in got)
    assert treeweight.score_documents(empty).count() == 0
    rounded = lambda df: Counter((r.doc_id, r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in treeweight.score_documents(df).collect())
    assert rounded(clashing) == rounded(docs)


def brute_deep(train, text, depth):
    """Context-tree weighting over depths 0 to ``depth``, one bit at a time, contexts as strings of the bytes before."""
    counts = defaultdict(lambda: [0, 0])

    def bits(data):
        padded = b"\0" * depth + data
        for i, byte in enumerate(data, depth):
            for k in range(8):
                yield [(padded[i - d : i], 1 << k | byte >> (8 - k)) for d in range(depth + 1)], byte >> (7 - k) & 1

    for t in train:
        for path, bit in bits(t.encode()):
            for c in path:
                counts[c][bit] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)

    children = defaultdict(float)
    for c, n in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        log = kt(n) if len(c[0]) == depth else np.logaddexp(kt(n), children[c]) - math.log(2)
        if c[0]:
            children[(c[0][1:], c[1])] += log
    total = 0.0
    for path, bit in bits(text.encode()):
        p = 0.0
        for c in reversed(path):
            n = counts.get(c, (0, 0))
            share = 1.0 if len(c[0]) == depth else 1 / (1 + math.exp(min(700, max(-700, children.get(c, 0.0) - kt(n)))))
            p = share * (n[1] + 0.5) / (n[0] + n[1] + 1) + (1 - share) * p
        total += math.log10(p if bit else 1 - p)
    return total


def test_deep_contexts_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["alphabet", "alphabetic", "betting", "abet", "\0", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(40)] + [(41, None), (42, ""), (43, "a"), (44, "zzzzzzzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t or "" for d, t in rows if not treeweight.held_out(d)]
    for depth in (1, 5, 6):
        got = {r.doc_id: r.score for r in treeweight.score_documents(df, depth=depth).collect()}
        assert got == {d: pytest.approx(brute_deep(train, t or "", depth), rel=1e-9, abs=1e-9) for d, t in rows}


def test_the_query_predicts_from_more_than_two_bytes(spark, tmp_path):
    from pactum.llm.queries import op10_context_tree_scores

    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["xabcd1", "yabcd2"]) for _ in range(40))
    spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_context_tree_scores(spark, str(tmp_path)).filter("held_out").collect()
    # the last byte follows from the first, five before it: one bit a word, where two bytes of context need two
    assert got and all(-r.score * math.log2(10) / 40 < 1.5 for r in got)


def fewest_bins(counts, capacity):
    """Exact optimum: the largest piece left with every filling around it."""
    from functools import cache

    lengths = sorted(counts, reverse=True)

    @cache
    def fewest(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)
        best = [sum(left)]

        def fill(i, room, now):
            if i == len(left):
                best[0] = min(best[0], 1 + fewest(tuple(now)))
                return
            for n in range(min(now[i], room // lengths[i]) + 1):
                fill(i + 1, room - n * lengths[i], [*now[:i], now[i] - n, *now[i + 1 :]])

        fill(first, capacity - lengths[first], [*left[:first], left[first] - 1, *left[first + 1 :]])
        return best[0]

    return fewest(tuple(counts[a] for a in lengths))


def bins(counts, capacity):
    return sum(n for _, n in packing.plan(counts, capacity)[0])


def test_fewer_copies_of_a_length_are_tried():
    assert bins({8: 1, 3: 4, 2: 5}, 15) == 2 == fewest_bins({8: 1, 3: 4, 2: 5}, 15)
    assert bins({2185: 5, 819: 20, 546: 25}, 4096) == 10


def test_plans_equal_the_exact_optimum():
    rng = random.Random(6)
    for _ in range(300):
        counts = {rng.randint(2, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        assert bins(counts, 15) == fewest_bins(counts, 15), counts


def test_top_k_of_large_components(spark):
    """Finite vectors of any size take part; what is beyond a long is an error."""
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(50, [1.0, 2.0]), (1, [600000.0, 1.0]), (2, [500000.0, 1.0]), (3, [3.0, 4.0]), (4, [-1e12, 7.0])], schema)
    asked = spark.createDataFrame([(100, [1.0, 2.0])], schema)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, asked, 9).orderBy("rank").collect()]
    wanted = sorted(((-(256 * int(256 * a) + 512 * int(256 * b)), i) for i, (a, b) in ((r["vec_id"], r["embedding"]) for r in df.collect())))
    assert got == [(n, i, -s) for n, (s, i) in enumerate(wanted, 1)] and got[0] == (1, 1, 39_321_731_072)
    for bad in ([1e300, 0.0], [3e16, 3e16]):
        with pytest.raises(Exception, match="range of long|int too large|too big|int64|overflow"):
            topk.top_k(df.union(spark.createDataFrame([(9, bad)], schema)), spark.createDataFrame([(100, [3e16, 3e16])], schema), 2).collect()


def test_top_k_leaves_out_the_query_s_own_row_alone(spark):
    schema = "vec_id long, embedding array<float>, own string, rank int, hash int"
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 3).collect())
    one, two = 256 * 256, 512 * 256
    assert got == sorted([(50, 1, 50, two), (50, 2, 7, one), (50, 3, 8, one), (50, 1, 7, two), (50, 2, 8, two), (50, 3, 50, two)])
