"""The whole pipeline against a plain Python version on a small corpus."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pactum.llm import tokens
from test_filters import base_marks, brute_lines, learn_text_order, normal, row_key, words
from test_models import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def quality(rows):
    """A null id is a document of its own row, after all others; the tests give such rows no common line."""
    docs, held = defaultdict(set), defaultdict(set)
    for k, r in enumerate(rows):
        name = (r[0] is None, k if r[0] is None else r[0])
        docs[r[3]].add(name)
        for x in (r[1] or "").split("\n"):
            if words(x):
                held[(r[3], normal(x))].add(name)
    common = {k: min(v)[1] for k, v in held.items() if len(v) > 10 and 100 * len(v) > 5 * len(docs[k[0]])}
    out = []
    for r in rows:
        n, *_, failed = base_marks(r[1])
        gone = sum(len(words(x)) for x in (r[1] or "").split("\n") if common.get((r[3], normal(x)), r[0]) != r[0])
        if not failed and not (gone and (100 * (n - gone) < 50 * n or n - gone < 10)):
            out.append(r)
    return out


def lines(rows):
    removed = defaultdict(set)
    for key, i in brute_lines(rows):
        removed[key].add(i)
    out = []
    for r in rows:
        kept = "\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in removed[row_key(r)])
        if words(kept) or not words(r[1]):
            out.append((r[0], kept if r[1] is not None else None, *r[2:4], len(kept)))
    return out


def near(rows):
    """Of the rows of a document one, rows of null id each, unless a document has the same set."""
    known = [r for r in rows if r[0] is not None]
    keep = {d for d, _, c in brute_components(known, 5, 80) if d == c} | {r[0] for r in known if not words(r[1])}
    sets = {tuple(sorted(shingles(r[1]))) for r in known}
    return [r for r in dict.fromkeys(known) if r[0] in keep] + [r for r in rows if r[0] is None and tuple(sorted(shingles(r[1]))) not in sets]


def shingles(text, size=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def mix(rows):
    name = lambda r: str(r[1] if r[0] is None else r[0])
    size, slot = {name(r): len(words(r[1])) for r in rows}, {name(r): int(hashlib.md5(name(r).encode()).hexdigest()[:5], 16) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[name(r)]
    order = sorted(total)
    weight, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        goal = 3 * total[s] if s in capped else level * weight[s]
        whole = math.floor(goal / total[s]) if total[s] else 0
        rest, before = goal - whole * total[s], 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (slot[name(r)], r[0] is None, r[0] or 0, size[name(r)])):
            out += [r] * (whole + (before < rest and 2 * before + size[name(r)] <= 2 * rest))
            before += size[name(r)]
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    from conftest_corpus import corpus

    rows = corpus(150, seed=4, words=120)
    menu = "Home and news and search and terms and help and about and login and more of it"
    rows += [(2000 + i, "\n".join([menu, menu.upper(), f"own words of page {i} that nobody else has so far here"][: 2 + i % 2]), "en", "src0", 1) for i in range(24)]
    rows += [(None, f"words of a row without id {i} that are its own and enough of them to stay {i * i} here", "en", "src1", 1) for i in range(6)]
    rows += [(None, None, "en", "src0", None), (3000, None, None, "src1", None), *[(3001, "one row that stands there three times with more than ten words", "en", "src2", 9)] * 3]
    learn_text_order(spark, rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    left = mix(near(lines(quality(rows))))
    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for r in left:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, tokens.END_ID]
        want[(r[0], 0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == math.ceil(sum(r.length for r in got) / 4096)
    assert 0 < len(left) and len(quality(rows)) < len(rows) and len(near(lines(quality(rows)))) < len(quality(rows))
