"""Quality rules: repetition within a text, line frequency across documents.

Native DataFrame code. Words are runs outside 0x20 and 0x09-0x0D. The rules:

* base: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of
  the words lie in five-word windows that occur twice or more in the text;
* method: lines are normalised (lower case, white space runs to one space,
  trimmed) and hashed. A line is common on a host when more distinct documents of
  the host hold it than the limit, the larger of ``min_docs`` and ``host_percent``
  percent of the host's documents. Common lines are removed from all documents
  but the first that has them (by doc_id); a document that keeps fewer than
  ``keep_percent`` percent of its words, or fewer than ``min_words``, is depleted
  and rejected.

The host of a document is its source; null is a host of its own. The limit grows
with the host: on a host of a million documents a line that 50,000 of them hold is
not common yet. Null and empty texts have no words and fail the base; texts of any
length are judged whole. Repeated rows get equal results; rows that repeat a doc_id
count as one document. Rows of null doc_id are a document each, after all others.
An empty table gives an empty result; columns other than doc_id, text and source
play no part, whatever their names, and ``passing`` carries them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.rowkeys import SPACE, TEXT_HASH, let, only_rows, text_hash, words
from pactum.plans.scratch import discard, small, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"

MIN_WORDS, REPEAT_PERCENT = 10, 20
MIN_DOCS, HOST_PERCENT, KEEP_PERCENT = 10, 5, 50


def repeated_window_words(w: Column, n: int = WINDOW) -> Column:
    """Words of array ``w`` that lie in an n-word window found twice or more."""
    zero = F.lit(0).cast("long")

    def of_hashes(hs: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(pairs, i + d)["h"] == x["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), zero, lambda s, x: s + x))

        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(let(pairs, of_pairs))

    def of_words(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(a) - n)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(n)))), of_hashes)

    return F.when(F.size(w) <= n, zero).otherwise(let(w, of_words))


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def quality_marks(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, text hash, counts, and (hash, words) of each line that has a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("_t"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda s: F.length(F.regexp_replace(s, SPACE, "")) > 0)
    normal = F.transform(F.split("_t", "\n"), normal_line)
    normal = F.filter(normal, lambda s: s != "")
    return base.select(
        "doc_id",
        "source",
        text_hash(F.col("_t")).alias(TEXT_HASH),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_w")).alias("n_repeat_words"),
        F.transform(normal, lambda s: F.struct(F.xxhash64(s).alias("h"), F.size(F.split(s, " ")).alias("words"))).alias("lines"),
    )


def score_quality(docs: DataFrame, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, min_docs: int = MIN_DOCS, host_percent: int = HOST_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, and the text hash."""
    marks = written(quality_marks(docs.select("doc_id", "source", "text")).withColumn("_row", F.monotonically_increasing_id()), "quality")
    # a document is named by its doc_id, one without by its row
    name = [F.col("doc_id").alias("_doc"), F.when(F.col("doc_id").isNull(), F.col("_row")).alias("_own")]
    held = marks.select("source", *name, F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    # rows that repeat a doc_id are few: only theirs are compared, the others hold each line once already
    repeats = small(written(marks.filter("doc_id is not null").groupBy("source", "doc_id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.col("source").alias("_rs"), F.col("doc_id").alias("_rd")), "repeats"))
    again = F.col("source").eqNullSafe(F.col("_rs")) & (F.col("_doc") == F.col("_rd"))
    held = held.join(repeats, again, "left_anti").unionByName(held.join(repeats, again, "left_semi").distinct())
    hosts = marks.groupBy("source").agg((F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("_docs"))
    often = held.groupBy("source", "h").agg(F.count("*").alias("_n"), F.min("_doc").alias("_first"), F.min("_own").alias("_first_own")).filter(F.col("_n") > min_docs)
    often = written(often, "often")
    hosts = written(hosts, "hosts")
    o, g = often.alias("o"), small(hosts).alias("g")
    common = o.join(g, F.col("o.source").eqNullSafe(F.col("g.source"))).filter(100 * F.col("_n") > host_percent * F.col("_docs"))
    common = written(common.select(F.col("o.source").alias("_host"), F.col("h").alias("_h"), "_first", "_first_own"), "common")
    lines = marks.select("_row", "source", *name, F.explode("lines").alias("_l")).select("_row", "source", "_doc", "_own", "_l.h", "_l.words")
    is_first = F.when(F.col("_first").isNull(), F.col("_own") == F.col("_first_own")).otherwise(F.col("_doc").eqNullSafe(F.col("_first")))
    hit = lines.join(small(common), (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_host"))).filter(~is_first)
    removed = written(hit.groupBy("_row").agg(F.sum("words").alias("n_removed_words")), "removed")
    discard(often, hosts)
    out = marks.drop("lines").join(removed.hint("merge"), "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((100 * left < keep_percent * F.col("n_words")) | (left < min_words))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words", TEXT_HASH)


def passing(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    # fewer rows are rejected than kept; of equal rows without an id one may hold a common line first, then all stay
    rejected = score_quality(docs, **limits).groupBy("doc_id", TEXT_HASH).agg(F.bool_or("kept").alias("_any")).filter("not _any")
    return only_rows(docs, written(rejected.drop("_any"), "rejected"), "left_anti")


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY doc_id),
ls AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM t),
lw AS (SELECT doc_id, source, l, trim(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), ' ') AS nl FROM ls WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM t GROUP BY source),
freq AS (SELECT source, nl, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM lw GROUP BY source, nl),
common AS (SELECT f.source, f.nl, f.first FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 10 AND 100 * f.n > 5 * h.docs),
rem AS (SELECT l.doc_id, sum(len(string_split(l.nl, ' '))) AS n FROM lw l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.nl = c.nl AND l.doc_id <> c.first GROUP BY l.doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
 coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed_words
 FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_removed_words > 0 AND (100 * (n_words - n_removed_words) < 50 * n_words OR n_words - n_removed_words < 10)) AS kept, n_removed_words
FROM f
"""
