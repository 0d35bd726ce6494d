"""The registered queries: against their SQL, and the pipeline against plain versions of its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import edges
from changeflow.llm import compression_toxicity, queries
from changeflow.llm.repetition import measure
from edges import SMALL
from oracle import compare, connect
from test_llm_search import plain_components
from test_llm_tokens import check_packed

QUERIES, ORACLE = queries.load()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    rows, problem = compare(spark, connect(SMALL), QUERIES[name], ORACLE[name], SMALL)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"pipeline"}))
def test_query_returns_a_row_for_each(spark, name):
    got = QUERIES[name](spark, SMALL)
    table, key = ("embeddings", "vec_id") if name.startswith("op1_") else ("documents", "doc_id")
    want = spark.read.parquet(f"{SMALL}/{table}.parquet").select(key)
    if table == "embeddings":
        want, got = want.where("vec_id % 50 = 0"), got.selectExpr("query_id AS vec_id")
    assert sorted(r[0] for r in got.select(key).distinct().collect()) == sorted(r[0] for r in want.collect())


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def plain_groups(rows):
    """Ids and texts of each group of linked texts."""
    texts = list(dict.fromkeys(t for _, t in rows))
    roots = plain_components(list(enumerate(texts)))
    groups = {}
    for k, t in enumerate(texts):
        ids, group = groups.setdefault(roots[k], ([], set()))
        group.add(t)
        ids += [i for i, u in rows if u == t]
    return list(groups.values())


def stages(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def check_stages(spark, frames):
    documents, clean, decent, single, packed = frames
    assert clean.columns == decent.columns == single.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    keep = measure([t for _, t in rows]).kept.tolist()
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(rows, key=key)
    model = compression_toxicity.learn_toxicity(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    p = compression_toxicity.score(model, [t for _, t in rows])
    rows = [r for r, x in zip(rows, p, strict=True) if x < 0.3]
    assert sorted(((r.doc_id, r.text) for r in decent.collect()), key=key) == sorted(rows, key=key)
    got = [(r.doc_id, r.text) for r in single.collect()]
    for ids, group in plain_groups(rows):
        least = min(ids, key=lambda i: (i is None, i or 0))
        stayed = [(i, t) for i, t in got if t in group]
        assert len(stayed) == 1 and stayed[0][0] == least
    assert len(got) == len(plain_groups(rows))
    check_packed(packed.collect(), [(r.doc_id, r.text) for r in single.collect()], 1024)
    return np.array([f.count() for f in frames[:4]])


def test_pipeline_equals_its_plain_stages(spark, folder):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = check_stages(spark, stages(spark, documents, folder))
    assert (np.diff(counts) <= 0).all() and counts[0] > counts[1] and counts[2] > counts[3] > 0
    run = entry.queries()["pipeline"](spark, SMALL)
    once = spark.read.parquet(f"{folder}/packing")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run.select(*columns).exceptAll(once.select(*columns)).count() == 0 and run.count() == once.count()


def test_pipeline_on_odd_rows(spark, folder):
    varied = " ".join(f"v{i}" for i in range(80))
    more = spark.createDataFrame(
        [(20, varied), (21, varied.upper()), (22, varied + " end"), (23, varied[::-1]), (23, varied[::-1]), (None, varied)], edges.SCHEMA
    )
    docs = edges.documents(spark).unionByName(more, allowMissingColumns=True)
    counts = check_stages(spark, stages(spark, docs, folder))
    assert counts.tolist() == [19, 7, 7, 3]
    none = stages(spark, edges.empty(spark), folder + "-none")
    assert [f.count() for f in none] == [0] * 5
    assert none[1].where(F.lit(True)).columns == ["doc_id", "text"]
