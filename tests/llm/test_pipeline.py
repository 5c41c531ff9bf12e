"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefloom.llm import base, queries, quality

from ..oracle import same
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, small, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], small)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.collect()}

    good = stages["quality"](spark, docs, small)
    scored = quality.quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert good.columns == docs.columns and ids(good) == ids(scored.where("score >= 0.5"))

    one = stages["near_duplicates"](spark, docs, small)
    assert one.columns == docs.columns
    assert ids(one) == {i for i, _, _, kept in brute.near_duplicates(sorted(texts.items()), 80) if kept}

    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, small)
    assert clean.columns == docs.columns
    assert ids(clean) == {r[0] for r in brute.contamination(sorted(texts.items()), bench) if not r[-1]}

    mix = stages["mixing"](spark, docs, small)
    assert mix.columns == docs.columns and all(texts[r.doc_id] == r.text for r in mix.collect())


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    order = out.orderBy("start").collect()
    assert order and order[0].start == 0 and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(order, order[1:]))


def clashing(spark, small, folder, empty=False):
    """Tables whose documents have null ids, nulls in every column, repeated rows, a very long text and the operators' names as columns."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["rate", "copy", "_source", "_n", "mix_key", "score", "kept", "matches", "n_hit", "_row", "_text_key", "component_id"]
    docs = docs.limit(60).unionByName(docs.limit(5)).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    lone = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long"))
    nulls = docs.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    long = docs.limit(1).withColumn("doc_id", F.lit(10**12)).withColumn("text", F.repeat(F.lit("some words of a very long text. "), 60_000))
    wordless = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10**9).withColumn("text", F.lit(" \n"))
    out = docs.unionByName(lone).unionByName(nulls).unionByName(long).unionByName(wordless)
    (out.limit(0) if empty else out).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        x = spark.read.parquet(f"{small}/{t}.parquet")
        (x.limit(0) if empty else x).write.parquet(f"{folder}/{t}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), names


def test_stages_with_nulls_and_clashing_names(spark, small, tmp_path):
    docs, names = clashing(spark, small, f"{tmp_path}/t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.schema(docs.schema).parquet(written(stage(spark, docs, f"{tmp_path}/t"), f"{tmp_path}/{name}"))
        assert {tuple(r) for r in docs.select(*names).distinct().collect()} <= {tuple(range(len(names))), (None,) * len(names)}, name
        assert docs.where("text is null or length(trim(text)) <= 1").count() > 0 or name == "mixing"
    out = corpus_pipeline.run(spark, f"{tmp_path}/t").collect()
    assert len(out) > 20 and all(r.n_tokens > 0 for r in out)


def written(df, path):
    df.write.parquet(path)
    return path


def test_run_of_nothing(spark, small, tmp_path):
    docs, _ = clashing(spark, small, f"{tmp_path}/t", empty=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/t")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/t").collect() == []


def test_discard(spark, small):
    """A run's tables lie in one folder, which can be discarded."""
    base.stored(spark.range(3), "test")
    assert os.path.isdir(base.run_folder(spark).removeprefix("file://").removeprefix("file:"))
    base.discard_run(spark)
    assert not os.path.exists(base.run_folder(spark).removeprefix("file://").removeprefix("file:"))
