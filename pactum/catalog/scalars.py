"""The scalar surface, one query a function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pactum.catalog._base import query
from pactum.functions import scalars as fn
from pactum.operators import canonical, checks

WORDS = "[A-Za-z]+"
_TOKENS = "(SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:12] AS w FROM documents)"


def tokens(t):
    return t.documents.select("doc_id", F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), 1, 12).alias("w"))


def of(table: str, key: str, name: str, column, sql: str, source: str | None = None):
    """Register fn_<name>: key and one computed column of a table."""

    def run(t):
        df = tokens(t) if table == "tokens" else getattr(t, table)
        return df.select(key, column().alias("v"))

    query(f"SELECT {key}, {sql} AS v FROM {source or (_TOKENS if table == 'tokens' else table)}", f"fn_{name}")(run)


c = F.col
of("customer", "c_custkey", "abs", lambda: F.abs("c_acctbal"), "abs(c_acctbal)")
of("embeddings", "vec_id", "all", lambda: fn.all_of(c("embedding"), lambda x: x > -0.3), "len(list_filter(embedding, lambda x: x > -0.3)) = len(embedding)")
of("embeddings", "vec_id", "any", lambda: fn.any_of(c("embedding"), lambda x: x > 0.3), "len(list_filter(embedding, lambda x: x > 0.3)) > 0")
of("part", "p_partkey", "bool", lambda: fn.truth(c("p_size") - 10, "number") & fn.truth(F.when(c("p_size") > 5, c("p_name")).otherwise(""), "string"), "p_size <> 10 AND p_size > 5")
of("lineitem", "l_orderkey", "int", lambda: (-c("l_extendedprice")).cast("bigint"), "trunc(-l_extendedprice)::BIGINT")
of("lineitem", "l_orderkey", "float", lambda: F.concat(c("l_linenumber").cast("string"), F.lit(".5")).try_cast("double"), "l_linenumber + 0.5::DOUBLE")
of("lineitem", "l_orderkey", "str", lambda: c("l_partkey").cast("string"), "l_partkey::VARCHAR")
of("nation", "n_nationkey", "dict", lambda: F.map_from_entries(F.array(F.struct(F.lit("name").alias("k"), c("n_name").alias("v")), F.struct(F.lit("key").alias("k"), c("n_regionkey").cast("string").alias("v"))))["name"], "n_name")
of("nation", "n_nationkey", "list", lambda: F.array("n_nationkey", "n_regionkey"), "[n_nationkey, n_regionkey]")
of("nation", "n_nationkey", "tuple", lambda: F.struct("n_name", "n_regionkey")["n_name"], "n_name")
of("tokens", "doc_id", "set", lambda: fn.unique(c("w")), "list_sort(list_distinct(w))")
of("tokens", "doc_id", "enumerate", lambda: F.transform(fn.enumerated(c("w")), lambda s: F.concat(s["i"].cast("string"), F.lit(":"), s["x"])), "list_transform(w, lambda x, i: (i - 1) || ':' || x)")
of("embeddings", "vec_id", "zip", lambda: F.size(fn.zipped(c("embedding"), F.slice("embedding", 3, 10))), "10::INT")
of("part", "p_partkey", "range", lambda: fn.counted(c("p_size") - 20), "range(0, greatest(p_size - 20, 0))::INT[]")
of("tokens", "doc_id", "reversed", lambda: F.reverse("w"), "list_reverse(w)")
of("tokens", "doc_id", "sorted", lambda: F.array_sort("w"), "list_sort(w)")
of("documents", "doc_id", "len", lambda: F.length("text"), "length(text)::INT")
of("embeddings", "vec_id", "max", lambda: F.array_max("embedding"), "list_max(embedding)")
of("embeddings", "vec_id", "min", lambda: F.array_min("embedding"), "list_min(embedding)")
of("events", "event_id", "isinstance", lambda: checks.dynamic_kind(c("props"), "$.k") == "integer", "json_type(props->'$.k') IN ('BIGINT', 'UBIGINT')")
of("events", "event_id", "type", lambda: checks.dynamic_kind(c("props")), "'map'")
of("embeddings", "vec_id", "sum", lambda: F.round(fn.total(F.transform("embedding", lambda x: x.cast("double"))), 6), "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6)")
of("lineitem", "l_orderkey", "round", lambda: fn.rounded(c("l_linenumber") + F.lit(0.5)), "round_even(l_linenumber + 0.5, 0)")
of("events", "event_id", "hasattr", lambda: fn.has(c("props"), "$.k") & ~fn.has(c("props"), "$.z"), "(props->'$.k') IS NOT NULL AND (props->'$.z') IS NULL")
of("events", "event_id", "getattr", lambda: fn.get(c("props"), "$.k", "bigint", 0) + fn.get(c("props"), "$.z", "bigint", -5), "coalesce((props->>'$.k')::BIGINT, 0) - 5")
of("part", "p_partkey", "fullmatch", lambda: checks.full_match(c("p_brand"), r"Brand#[1-3]|Brand#4\d"), "regexp_full_match(p_brand, 'Brand#[1-3]|Brand#4\\d')")
of("customer", "c_custkey", "strip", lambda: canonical.stripped(F.concat(F.lit("\t\n "), "c_name", F.lit(" \r\n"))), "c_name")
of("customer", "c_custkey", "lower", lambda: F.lower("c_name"), "lower(c_name)")
of("customer", "c_custkey", "upper", lambda: F.upper("c_name"), "upper(c_name)")
of("pages", "page_id", "startswith", lambda: c("url").startswith("https://m."), "starts_with(url, 'https://m.')")
of("orders", "o_orderkey", "in", lambda: c("o_orderpriority").isin("1-URGENT", "5-LOW"), "o_orderpriority IN ('1-URGENT', '5-LOW')")
of("part", "p_partkey", "mod", lambda: fn.modulo(-c("p_size"), 7), "(7 - p_size % 7) % 7")
of("events", "event_id", "dict_get", lambda: F.coalesce(F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("z")), F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k"))), "(props->>'$.k')::BIGINT")
of("events", "event_id", "dict_items", lambda: F.transform(F.map_entries(F.from_json("props", "map<string,bigint>")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "['k=' || (props->>'$.k')]")
of("events", "event_id", "dict_keys", lambda: F.map_keys(F.from_json("props", "map<string,bigint>")), "json_keys(props)")
of("events", "event_id", "dict_values", lambda: F.map_values(F.from_json("props", "map<string,bigint>")), "[(props->>'$.k')::BIGINT]")
of("orders", "o_orderkey", "iso_time", lambda: F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')")


@query("SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY 1", "fn_all_any_groups")
def all_any_groups(t):
    return t.orders.groupBy("o_orderpriority").agg(F.bool_and(c("o_totalprice") > 1000).alias("every"), F.bool_or(c("o_totalprice") > 400000).alias("some"))


@query("SELECT p_partkey, p_size % 2 = 0 AND p_size > 4 AS ok FROM part")
def udf_predicate(t):
    """A predicate that has no Column form, batch by batch."""
    @F.pandas_udf("boolean")
    def even(size: pd.Series) -> pd.Series:
        return (size % 2 == 0) & (size > 4)

    return t.part.select("p_partkey", even("p_size").alias("ok"))


@query("SELECT c_custkey, lower(c_name) || '!' AS name FROM customer")
def udf_canonical(t):
    @F.pandas_udf("string")
    def form(name: pd.Series) -> pd.Series:
        return name.str.lower() + "!"

    return t.customer.select("c_custkey", form("c_name").alias("name"))
