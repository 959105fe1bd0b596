"""The pipeline stage by stage, and its queries against SQL."""

import glob

import duckdb
import pytest

import corpus_pipeline
from pactum.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*' if glob.glob(p + '/*') else p}')")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "source mix", "packing"]


def test_stages_take_effect_and_keep_columns(spark, docs):
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, "").persist()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() and (out.count() <= seen.count() or name == "source mix")
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, "")
    assert packed.select("doc_id", "piece").distinct().count() > 0


def test_pipeline_on_an_empty_table(spark, empty):
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0
