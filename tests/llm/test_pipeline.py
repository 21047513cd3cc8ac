"""The pipeline against stages made by brute force, and the registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlab.llm import decontaminate, queries

from .test_operators import brute_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, out = docs.columns, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf).cache()
        assert docs.columns == names
        out.append(docs)
    good, lines, groups, clean = out
    n = good.count()
    assert 0 < n < spark.read.parquet(f"{sf}/documents.parquet").count()
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (good, lines))
    assert set(after) <= set(before)
    for k, text in after.items():
        left = iter(before[k].split("\n"))
        assert all(line in left for line in text.split("\n"))  # lines only go, in order
    want = brute_components(list(after.items()), 5, 80)
    assert {r.doc_id for r in groups.collect()} == {k for k, (_, c) in want.items() if c == k}
    found = decontaminate.contamination(groups, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in found.where("not contaminated").collect()}
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    size = clean.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(mixed.agg(F.sum("n_words")).first()[0] - size) <= 20


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
