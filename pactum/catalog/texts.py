"""Text-corpus jobs; source files are made of the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.operators import text


def sources(t):
    """A source file for each document: loads, assignments and functions named by its number, and from line 9 on its text."""
    k = F.col("doc_id")
    body = F.concat(
        F.lit('"""doc"""\nload("//lib/l'), k % 7, F.lit('.x", "A'), k % 3, F.lit('",\n  "B", own="C")\nX'), k, F.lit(" = 1\n  Y = 2\ndef f"), k % 5, F.lit("(a):\n  return a == X\nX"), k, F.lit(" = 3\nZ == 4\n"), F.coalesce("text", F.lit(""))
    )
    return t.documents.select("doc_id", body.alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) + 9 AS n FROM documents),
s AS (SELECT doc_id, regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_]*)\s*=([^=]|$)', 1) AS a, regexp_extract(l, '^def\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS f, n FROM l),
every AS (SELECT doc_id, CASE WHEN a <> '' THEN a ELSE f END AS symbol, n FROM s WHERE a <> '' OR f <> '' UNION ALL SELECT doc_id, 'X' || doc_id, 3 FROM documents UNION ALL SELECT doc_id, 'f' || doc_id % 5, 5 FROM documents)
SELECT doc_id, symbol, min(n)::INT AS line_no FROM every GROUP BY doc_id, symbol""")
def symbol_index(t):
    return text.symbol_index(sources(t), "doc_id", "text")


@query("""SELECT doc_id, '//lib/l' || doc_id % 7 || '.x' AS target, 'A' || doc_id % 3 AS symbol FROM documents UNION ALL SELECT doc_id, '//lib/l' || doc_id % 7 || '.x', 'B' FROM documents""")
def import_edges(t):
    return text.import_edges(sources(t), "doc_id", "text")


@query("""SELECT doc_id AS src, '//lib/l' || doc_id % 7 || '.x' AS target, CASE WHEN doc_id % 2 = 0 THEN 'A' || doc_id % 3 ELSE 'B' END AS symbol,
 CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN 'resolved' ELSE 'missing' END AS status FROM documents
 UNION ALL SELECT doc_id, '//lib/l' || doc_id % 7 || '.x', unnest(['A0', 'B']), 'default' FROM documents""")
def import_symbols(t):
    edges = text.import_edges(sources(t), "doc_id", "text").withColumnRenamed("doc_id", "src")
    named = edges.filter(F.when(F.col("src") % 2 == 0, F.col("symbol").startswith("A")).otherwise(F.col("symbol") == "B"))
    files = t.documents.select(F.concat(F.lit("//lib/l"), F.col("doc_id") % 7, F.lit(".x")).alias("file")).distinct().select("file", F.explode(F.array(F.lit("A0"), F.lit("B"), F.lit("_hidden"))).alias("symbol"))
    resolved, missing = text.import_symbols(named, files)
    every, _ = text.import_symbols(edges.select("src", "target", F.lit(None).cast("string").alias("symbol")).distinct(), files)
    status = lambda df, s: df.withColumn("status", F.lit(s))
    return status(resolved, "resolved").unionByName(status(missing, "missing")).unionByName(status(every, "default"))


@query("SELECT doc_id, token, count(*)::BIGINT AS n, min(p)::INT AS first FROM (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM documents)) GROUP BY doc_id, token")
def identifier_tokens(t):
    return text.identifier_counts(t.documents, "doc_id", "text")


def turn_edits(t):
    """Each conversation's turns as edits: the first replaces all, later ones put a mark, their text and number before line 0, column 2, for the mark that is there."""
    first = F.col("turn") == 0
    at = lambda v: F.when(~first, F.lit(v))
    body = F.when(first, F.concat(F.lit("ab\ncd"), F.col("conv_id"))).otherwise(F.concat(F.lit("#"), F.coalesce("text", F.lit("")), F.lit("\n"), "turn", F.lit(">")))
    return t.conversations.select("conv_id", F.col("turn").alias("seq"), at(0).alias("start_line"), at(2).alias("start_col"), at(0).alias("end_line"), at(3).alias("end_col"), body.alias("text"))


#: The texts after all edits: the turns' own texts, the last one first.
EDITED = """SELECT conv_id, count(*)::BIGINT AS edits, 'ab' || CASE WHEN max(turn) > 0 THEN '#' || string_agg(coalesce(text, '') || chr(10) || turn || '>', '' ORDER BY turn DESC) FILTER (turn > 0) ELSE '' END
 || chr(10) || 'cd' || conv_id AS text FROM conversations GROUP BY conv_id HAVING min(turn) = 0"""


@query(f"SELECT conv_id, text FROM ({EDITED})")
def apply_edit_log(t):
    """All turns of all conversations that begin with the first one."""
    begun = t.conversations.filter("turn = 0").select("conv_id").distinct()
    return text.apply_edit_log(turn_edits(t).join(begun, "conv_id", "left_semi"), "conv_id")
