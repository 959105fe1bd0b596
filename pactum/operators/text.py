"""Text-corpus jobs: lines, symbols, import edges, identifiers, edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.operators.pieces import Pieces

# The forms of definitions and loads in source text.
ASSIGNMENT = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)"
FUNCTION = r"^def\s+([A-Za-z_][A-Za-z0-9_]*)"
LOAD_CALL = r"(?s)\bload\(\s*(\"[^\"]*\"|'[^']*')(.*?)\)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def named_groups(text: Column, pattern: str, *names: str) -> Column:
    """A record of the groups of ``pattern`` by name, '' for one that takes no part; null where the pattern does not match."""
    groups = F.struct(*(F.regexp_extract(text, pattern, i).alias(n) for i, n in enumerate(names, 1)))
    return F.when(F.regexp_like(text, F.lit(pattern)), groups)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line)."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def symbol_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, symbol, line_no): the first line that assigns or defines each symbol."""
    lines = text_lines(df, key, text)
    found = F.regexp_extract("line", ASSIGNMENT, 1)
    name = F.when(found != "", found).otherwise(F.regexp_extract("line", FUNCTION, 1))
    return lines.withColumn("symbol", name).filter("symbol <> ''").groupBy(key, "symbol").agg(F.min("line_no").alias("line_no"))


def import_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target, symbol) of ``load("path", "symbol", ...)``; calls may span lines, keyword aliases are skipped."""
    calls = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(LOAD_CALL), F.lit(0))).alias("_call"))
    body = F.regexp_replace("_call", LOAD_CALL, "$2")
    target = F.regexp_replace(F.regexp_extract("_call", LOAD_CALL, 1), r"^[\"']|[\"']$", "")
    plain = F.regexp_replace(body, r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    symbols = F.regexp_extract_all(plain, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1))
    return calls.select(key, target.alias("target"), F.explode(symbols).alias("symbol")).distinct()


def import_symbols(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, missing) named imports. ``edges`` is (src, target, symbol); without a symbol all public names come. ``symbols`` is (file, symbol)."""
    s = symbols.select(F.col("file").alias("target"), "symbol")
    named, every = edges.filter("symbol is not null"), edges.filter("symbol is null")
    resolved = named.join(s, ["target", "symbol"]).select("src", "target", "symbol").unionByName(every.select("src", "target").join(s.filter(~F.col("symbol").startswith("_")), "target").select("src", "target", "symbol"))
    return resolved, named.join(s, ["target", "symbol"], "left_anti").select("src", "target", "symbol")


def identifier_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, token): identifiers in order of appearance."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIER), F.lit(0))).alias("position", "token"))


def identifier_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, first): how often each identifier occurs under a key, and its least position in a text.

    Texts are dealt by key, so tokens are counted where their text lies and only texts are
    shuffled. Texts without a key would all lie together; their tokens are dealt instead.
    """
    counted = lambda rows: identifier_tokens(rows, key, text).groupBy(key, "token").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    rows = df.select(key, text)
    return counted(rows.filter(F.col(key).isNotNull()).repartition(key)).unionByName(counted(rows.filter(F.col(key).isNull())))


#: Columns of an edit beside its key.
EDIT = ("seq", "start_line", "start_col", "end_line", "end_col", "text")


def edited(text: Pieces, edit: dict) -> None:
    """One edit: a range splice, or whole replacement where the range is null; a null text counts as empty."""
    if edit["start_line"] is None:
        text.replace(edit["text"] or "")
    else:
        at = lambda line, col: (edit[line] or 0, edit[col] or 0)
        text.splice(at("start_line", "start_col"), at("end_line", "end_col"), edit["text"] or "")


def _folded(batches):
    """Of partitions in which a key's rows stand together in order: (key, text) of each key with an edit."""
    import pyarrow as pa

    key = text = None
    n, some = 0, False
    kind = None
    for batch in batches:
        kind = batch.column("_key").type
        done = []
        for row in batch.to_pylist():
            if not some or row["_key"] != key:
                if n:
                    done.append((key, text.text()))
                key, text, n, some = row["_key"], Pieces(), 0, True
            if row["_base"]:
                text.replace(row["text"] or "")
            else:
                edited(text, row)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([x for _, x in done], pa.string())], names=["_key", "text"])
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([text.text()], pa.string())], names=["_key", "text"])


def apply_edit_log(edits: DataFrame, key: str, base: DataFrame | None = None) -> DataFrame:
    """(key, text): each document's edits in the order of ``seq``; later ranges refer to the edited text. A missing base is empty.

    What stands before a key's last whole replacement is dropped by a window; the rest runs
    through its partition in order, one document at a time held in pieces, so a document
    costs what its edits change and its text is joined once. A null key is a document too.
    """
    kind = edits.schema[key].dataType
    rows = edits.select(F.col(key).alias("_key"), F.lit(False).alias("_base"), *EDIT)
    if base is not None:
        first = base.select(F.col(key).cast(kind).alias("_key"), F.lit(True).alias("_base"), "text")
        rows = rows.unionByName(first, allowMissingColumns=True)
    whole = F.col("_base") | F.col("start_line").isNull()
    later = Window.partitionBy("_key").orderBy("_base", *(F.col(c).desc_nulls_last() for c in EDIT)).rowsBetween(Window.unboundedPreceding, -1)
    # a base that is replaced goes as well; its key is there with the replacement
    left = rows.withColumn("_later", F.coalesce(F.sum(whole.cast("int")).over(later), F.lit(0))).filter("_later = 0")
    order = left.sortWithinPartitions("_key", F.col("_base").desc(), *(F.col(c).asc_nulls_first() for c in EDIT))
    out = T.StructType([T.StructField("_key", kind), T.StructField("text", T.StringType())])
    return order.drop("_later").mapInArrow(_folded, out).withColumnRenamed("_key", key)
