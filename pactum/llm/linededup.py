"""Line dedup across documents by a deletion-neighbourhood join.

Native DataFrame code. Lines are normalised (lower case, white space runs to one
space, trimmed); lines without a word are left alone. A line is removed when an
earlier line of the corpus is equal to it or, if both have ``MIN_CHARS`` characters
or more, within one edit (insert, delete or substitute one character). In a shorter
line one edit makes another word too easily; ``min_chars=1`` compares those as well.
Earlier is by (doc_id, text, line number): null ids come last, texts of one id go
by their hash.

Equal lines meet in one aggregation, so a line that a third of the corpus repeats
costs a row per task. Distinct lines are then compared:

* a line is cut into ``PIECES`` pieces; an edit touches one of them, so lines within
  one edit agree on all others for some cut. Lines that share such a remainder
  with no other line have no partner and go no further;
* the others emit, for the open piece, the piece itself and every variant of it
  with one character deleted, as hashed keys beside the remainder's key;
* equal keys meet. A variant of one line that is the open piece of another is an
  insertion; equal variants with the deletion at the same place, from lines of
  equal length, are a substitution. A key holds at most one line for each place
  and character, so its group is bounded by the alphabet and the line, not the corpus;
* the edit distance of each pair found is verified on the lines themselves.

A row is known by its doc_id and text: rows that are equal in both are one document
and keep the same lines; rows of one doc_id, or of none, with different texts are
documents of their own. Null texts have no lines and stay null; empty texts have
one line without a word. A text of any length is split once, and nothing of it but
line numbers meets in one row. Documents that lose all their words are dropped by
``deduplicated``; texts without a word beforehand stay. An empty table gives an
empty result. Other columns, whatever their names, are carried as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.rowkeys import let
from pactum.plans.scratch import discard, small, written

MIN_CHARS = 20
PIECES = 4

#: White space other than the line's end, by itself and as a run.
_SPACES = ("\t", "\x0b", "\x0c", "\r", "  ")
_RUN = "[\\x20\\x09\\x0B-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"

#: The columns that name a row, and with the line's number order lines.
_KEY = ("_null", "_doc", "_text")


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNull().alias("_null"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_doc"), F.xxhash64(text).alias("_text")]


def _lines(docs: DataFrame) -> DataFrame:
    """place (the row's key and the line's number) and normalised line of every line with a word."""
    text = F.col("text")
    plain = F.lower(F.when(reduce(or_, (text.contains(s) for s in _SPACES)), F.regexp_replace(text, _RUN, " ")).otherwise(text))
    lines = docs.select(*_key(F.col("doc_id"), text), F.posexplode(F.split(plain, "\n")).alias("line_no", "_line"))
    return lines.select(F.struct(*_KEY, "line_no").alias("place"), F.trim("_line").alias("line")).filter("line <> ''")


def _cuts(length: Column) -> Column:
    """Piece sizes under which a line is compared: its own, and that of lines one longer if it differs."""
    own, longer = (F.floor((length + k) / (2 * PIECES)).cast("int") * 2 for k in (0, 1))
    return F.when(own == longer, F.array(own)).otherwise(F.array(own, longer))


def _remainders(distinct: DataFrame) -> DataFrame:
    """id, rest, piece of each cut of each line: a key of all pieces of m characters but the open one, and the open one."""
    closed = PIECES - 1
    cut = distinct.select("id", "line", F.length("line").alias("n"), F.explode(_cuts(F.length("line"))).alias("m"))
    left = [F.xxhash64(F.substring(F.col("line"), F.col("m") * k + 1, F.col("m"))).alias(f"l{k}") for k in range(closed)]
    right = [F.xxhash64(F.substring(F.col("line"), F.col("n") - F.col("m") * (k + 1) + 1, F.col("m"))).alias(f"r{k}") for k in range(closed)]
    cut = cut.select("id", "line", "n", "m", *left, *right)
    rest = lambda i: F.xxhash64(F.lit(i), "m", *(f"l{k}" for k in range(i)), *(f"r{k}" for k in range(closed - i)))
    cut = cut.select("id", "line", "n", "m", F.explode(F.array(*(F.struct(rest(i).alias("rest"), F.lit(i).alias("i")) for i in range(PIECES)))).alias("_c"))
    return cut.select("id", "_c.rest", F.substring(F.col("line"), F.col("m") * F.col("_c.i") + 1, F.col("n") - F.col("m") * closed).alias("piece"))


def _variants(open_: DataFrame) -> DataFrame:
    """id, rest, size, at, hash of each open piece (at -1) and of its variants with one character deleted."""
    n = F.length("piece")
    each = open_.select("id", "rest", "piece", n.alias("size"), F.explode(F.sequence(F.lit(-1), n - 1)).alias("at"))
    cut = F.concat(F.substring(F.col("piece"), F.lit(1), F.col("at")), F.substring(F.col("piece"), F.col("at") + 2, F.col("size")))
    return each.select("id", "rest", "size", "at", F.xxhash64(F.when(F.col("at") < 0, F.col("piece")).otherwise(cut)).alias("hash"))


def near_pairs(distinct: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, earlier): ids of distinct lines with an equal key, for a written table (id, line, place)."""
    cut = _remainders(distinct.filter(F.length("line") >= min_chars))
    shared = cut.groupBy("rest").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a <> _b").select(F.col("rest").alias("_rest"))
    shared = small(written(shared, "shared"))
    # the pieces of a line's cuts are the line once, so beyond a broadcast each line is shuffled once
    keys = _variants(cut.join(shared, cut["rest"] == shared["_rest"], "left_semi"))
    # a key that only one line has meets nothing
    met = keys.groupBy("rest", "hash").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a <> _b").select(F.col("rest").alias("_rest"), F.col("hash").alias("_hash"))
    met = small(written(met, "met"))
    keys = keys.join(met, (keys["rest"] == met["_rest"]) & (keys["hash"] == met["_hash"]), "left_semi")
    order = distinct.select(F.col("id").alias("_id"), F.struct("place.*", "id").alias("place"))
    keys = small(written(keys, "keys"))
    keys = order.join(keys, keys["id"] == order["_id"])
    same = Window.partitionBy("rest", "hash")
    own = F.min(F.when(F.col("at") < 0, F.col("place"))).over(same)
    shorter = F.min(F.when(F.col("at") >= 0, F.col("place"))).over(same)
    substitution = F.min("place").over(Window.partitionBy("rest", "hash", "at", "size"))
    earlier = F.when(F.col("at") < 0, shorter).otherwise(F.least(own, substitution))
    return keys.select("id", "place", earlier.alias("_earlier")).filter("_earlier < place").select("id", F.col("_earlier.id").alias("earlier")).distinct()


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The key of each row that keeps lines with a word, and their numbers, ``_kept``."""
    distinct = _lines(docs).groupBy("line").agg(F.min("place").alias("place"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("id"), "line", "place"), "lines")
    pairs = written(near_pairs(distinct, min_chars), "near")
    told = small(pairs)
    # the earlier line of a pair is fetched first, then the pair's own
    earlier = distinct.join(told, distinct["id"] == told["earlier"]).select(told["id"].alias("_id"), F.col("line").alias("_earlier"))
    earlier = small(written(earlier, "earlier"))
    gone = distinct.join(earlier, distinct["id"] == earlier["_id"]).filter(F.levenshtein("line", "_earlier", 1) >= 0).select(F.col("id").alias("_gone")).distinct()
    gone = small(written(gone, "gone"))
    kept = distinct.select("id", "place").join(gone, F.col("id") == F.col("_gone"), "left_anti").select("place.*")
    return kept.groupBy(*_KEY).agg(F.collect_list("line_no").alias("_kept"))


def _numbers(lines: Column) -> Column:
    return F.coalesce(lines, F.array().cast("array<int>"))


def _worded(text: Column) -> Column:
    """Numbers of the lines with a word."""
    return _numbers(F.array_compact(F.transform(F.split(text, "\n"), lambda s, i: F.when(s.rlike(_WORD), i))))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, ascending) of each row; texts are not shuffled."""
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))), F.lit(0)).cast("long")
    rows = docs.select("doc_id", *_key(F.col("doc_id"), F.col("text")), n.alias("n_lines"), _worded(F.col("text")).alias("_worded"))
    out = rows.join(kept_lines(docs, min_chars).hint("merge"), list(_KEY), "left")
    out = out.select("doc_id", "n_lines", F.array_except("_worded", _numbers(F.col("_kept"))).alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the removed lines, all columns as they were; emptied documents are dropped."""
    text = F.col("_row.text")
    rows = docs.select(F.struct("*").alias("_row")).select("_row", *_key(F.col("_row.doc_id"), text))
    joined = rows.join(kept_lines(docs, min_chars).hint("merge"), list(_KEY), "left").select("_row", F.array_except(_worded(text), _numbers(F.col("_kept"))).alias("_removed"))
    # lines are picked by number, so a text costs its length however many lines it has
    left = let(F.split(text, "\n"), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("_removed")), lambda i: F.get(a, i)), "\n"))
    out = joined.select("_row", F.size("_removed").alias("_n"), F.when(F.size("_removed") == 0, text).otherwise(left).alias("_new"))
    out = out.filter((F.col("_n") == 0) | F.col("_new").rlike(_WORD))
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_n") == 0, F.col("_row.n_chars")).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType)))
    return out.select(row.alias("_row")).select("_row.*")


SQL = r"""
WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, line_no, trim(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), ' ') AS line FROM ls),
e AS (SELECT * FROM n WHERE line <> ''),
f AS (SELECT line, min(row(doc_id, line_no)) AS first, length(line) AS size FROM e GROUP BY line),
v AS (SELECT line, first, size, p, hash(substring(line, 1, p - 1) || substring(line, p + 1)) AS h FROM (SELECT *, unnest(range(1, size + 1)) AS p FROM f WHERE size >= 20)),
o AS (SELECT line, first, hash(line) AS h FROM f WHERE size >= 20),
near AS (SELECT a.first FROM v a JOIN v b ON a.h = b.h AND a.p = b.p AND a.size = b.size AND b.first < a.first
 UNION SELECT a.first FROM v a JOIN o b ON a.h = b.h AND b.first < a.first
 UNION SELECT a.first FROM o a JOIN v b ON a.h = b.h AND b.first < a.first),
gone AS (SELECT e.doc_id, e.line_no FROM e JOIN f USING (line) WHERE row(e.doc_id, e.line_no) <> f.first OR f.first IN (SELECT first FROM near)),
r AS (SELECT doc_id, list(line_no::INT ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(r.removed), 0)::BIGINT AS n_removed, coalesce(r.removed, []::INT[]) AS removed
FROM documents d LEFT JOIN r USING (doc_id)
"""
