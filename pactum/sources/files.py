"""Files as tables: listings, whole texts, permissive JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.operators.variants import step


def list_files(spark: SparkSession, roots: list[str], glob: str = "*", missing_ok: bool = True) -> DataFrame:
    """(path, length) below the roots, in path order; contents are not read; missing roots are skipped.

    Spark lists the folders, in parallel where there are many; its scan leaves out files of
    no bytes, so those that it listed and did not scan have the length 0.
    """
    parts = []
    for root in roots:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        except AnalysisException:
            if not missing_ok:
                raise
            continue
        # the index of the listed files is held by the driver as it is
        listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "value string")
        paths = listed.select(F.url_decode(F.regexp_replace(F.regexp_replace("value", r"^(\w+):///", "$1:/"), r"\+", "%2B")).alias("path"))
        parts += [found.select("path", "length"), paths.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("path") if parts else spark.createDataFrame([], "path string, length long")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _null_fields(node: Column, kind: T.StructType, optional: tuple[str, ...], path: str = "") -> Column:
    """Whether a declared field is there with a JSON null and not among the optional ones, at any depth of records."""
    out = F.lit(False)
    for f in kind.fields:
        name, at = f"{path}{f.name}", F.try_variant_get(node, f"${step(f.name)}", "variant")
        if name not in optional:
            out = out | F.coalesce(F.is_variant_null(at), F.lit(False))
        if isinstance(f.dataType, T.StructType):
            out = out | _null_fields(at, f.dataType, optional, f"{name}.")
    return out


def read_permissive(df: DataFrame, json: str, schema: str, optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose JSON parses into the schema, with ``parsed``; the others with error_class and message.

    Never stops at the first. Text that is no JSON is a ParseError; JSON that is no
    object, or holds a value of another type than declared, is a TypeError, and so is a
    null unless its field (a dotted path) is optional. A field may be left out.
    """
    parsed = F.from_json(F.col(json), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    tree = F.try_parse_json(F.col(json))
    shape = F.schema_of_variant(tree)
    wrong = ~shape.startswith("OBJECT") | F.col("_parsed._corrupt").isNotNull() | _null_fields(tree, T._parse_datatype_string(schema), optional)
    marked = df.withColumn("_parsed", parsed).withColumn("_error", F.when(F.col(json).isNull(), "MissingInput").when(shape.isNull(), "ParseError").when(wrong, "TypeError"))
    good = marked.filter("_error is null").select(*df.columns, F.col("_parsed").dropFields("_corrupt").alias("parsed"))
    said = F.when(F.col("_error") == "TypeError", F.concat(F.lit("not of the declared types: "), F.col(json))).otherwise(F.concat(F.lit("cannot parse "), F.coalesce(json, F.lit("null"))))
    bad = marked.filter("_error is not null").select(*df.columns, F.col("_error").alias("error_class"), said.alias("message"))
    return good, bad
