"""Learned partitions, near-duplicates and components against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import edges
from changeflow.llm import learned_partitions as lp
from changeflow.llm import components as components_of
from changeflow.llm import minhash
from changeflow.llm.components import components
from edges import SMALL


def nearest(ids, x, queries, top=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        out[int(q)] = sorted(((-round(float(v), 9), int(i)) for v, i in zip(s, ids, strict=True) if i != q))[:top]
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet")
    pdf = table.toPandas()
    want = nearest(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), [i for i in pdf.vec_id if i % 50 == 0])
    got = lp.search(table, F.col("vec_id") % 50 == 0).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id")["rank"].apply(sorted).map(tuple) == (1, 2, 3, 4, 5)).all()
    found = got.groupby("query_id").vec_id.apply(set)
    assert np.mean([len(found[q] & {i for _, i in w}) / 5 for q, w in want.items()]) >= 0.95


@pytest.mark.parametrize("block", [20_000, 40])
def test_all_partitions_visited_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(lp, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6))
    x[100:200] = x[100]  # a third of them copies, so ties everywhere
    x[200:300] = x[200] + 1e-3 * rng.standard_normal((100, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = lp.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, mass=2.0)
    want = nearest(np.arange(400), x, range(0, 400, 50))
    result = {}
    for r in got.orderBy("query_id", "rank").collect():
        result.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
    assert result == want


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (100, None), (3, [0.0, 0.0]),
        (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]),
        (150, [1e-200, 0.0]), (0, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS part", "'x' AS score")
    got = {}
    for r in lp.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 50, 150} and got[0][0] == 150 and set(got[50]) == {0, 1, 150}
    assert lp.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert lp.search(df, F.lit(False)).count() == 0


def test_tiny_and_huge_vectors_have_scores(spark):
    base = [[1.0, 0.5, 0.0], [1.0, 0.4, 0.1], [0.9, 0.5, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.2]]
    rows = [(i * 10 + k, [c * s for c in v]) for i, s in enumerate((1.0, 1e200, 1e-200, 1e307, 5e-310)) for k, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lp.search(df, F.col("vec_id") % 10 == 0, top=24).collect()
    assert len(got) == 5 * 24 and all(r.score is not None and -1 <= r.score <= 1 + 1e-12 for r in got)
    for r in got:
        a, b = np.array(base[r.query_id % 10]), np.array(base[r.vec_id % 10])
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-6)
    x = np.random.default_rng(1).standard_normal((50, 7))
    plain = (x[:1] * x).sum(axis=1) / (np.sqrt((x[:1] * x[:1]).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
    assert (lp.cosine(np.broadcast_to(x[0], x.shape), x) == plain).all()  # scaling by powers of two changes no digit


def test_queries_go_on_until_they_have_candidates(spark, monkeypatch):
    p = np.array([[0.99, 0.006, 0.003, 0.001]])
    assert lp._visits(p, 0.98, np.array([1, 3, 5, 9]), 6)[1].tolist() == [0, 1, 2]
    assert lp._visits(p, 0.98, np.array([9, 3, 5, 9]), 6)[1].tolist() == [0]
    # Equal vectors are dealt to many partitions of the sample, but all filed under one.
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(200 + i, [0.0, 1.0 + i]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts = lp.search(df, F.col("vec_id") >= 200).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in counts} == {200: 5, 201: 5, 202: 5}


def test_partitions_are_balanced():
    rng = np.random.default_rng(2)
    x = lp._unit(np.concatenate((rng.standard_normal((300, 8)), 5 + 0.01 * rng.standard_normal((300, 8)))))
    graph = lp.neighbour_graph(x, 5)
    label = lp.balanced_parts(x, graph, 6)
    assert np.bincount(label, minlength=6).max() <= np.ceil(1.05 * 100)
    cut = (label[graph] != label[:, None]).mean()
    assert cut < (rng.permutation(label)[graph] != label[:, None]).mean() - 0.2


def test_components(spark, folder):
    rng = random.Random(4)
    edge = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edge += [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (9000, 9001), (9001, 9000)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edge:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame([*edge, (None, 3), (3, None)], "u long, v long")
    got = {r.u: r.v for r in components(df, folder).collect()}
    assert got == {a: root(a) for a in parent if root(a) != a}
    assert components(df.limit(0), folder + "-none").count() == 0


def shingles(text):
    words = pd.Series([text or ""]).str.replace("[A-Z]", lambda m: m[0].lower(), regex=True).str.findall("[^\x20\x09-\x0d]+")[0]
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def near_copies(seed, n):
    """Originals, near copies around the threshold, a chain whose ends differ, exact copies, shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    rows, passage = [], [word() for _ in range(30)]
    base = [word() for _ in range(150)]
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(120)]
    for i in range(12):
        chain[5 * i] = word()
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(rng.randrange(12))])) for i in range(25)]
    rows += [(3000 + i, rows[0][1].upper()) for i in range(20)] + [(4000 + i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "size"), [(3, 8_000_000), (0, 20_000), (1, 8_000_000)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, turns, size):
    monkeypatch.setattr(minhash, "TURNS", turns)
    monkeypatch.setattr(minhash, "VERIFY_BYTES", size)
    rows = near_copies(turns, 60)
    got = minhash.near_duplicates(spark.createDataFrame(rows, edges.SCHEMA)).collect()
    want = plain_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    texts = dict(rows)
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_that_no_leader_sees_are_found(spark, monkeypatch):
    # One bucket of all documents: the hub of a family leads it at every turn, and x and y are linked only with each other.
    only = lambda sig: F.array(F.lit(1).cast("long"), *[F.xxhash64(F.lit(i), sig) for i in range(1, minhash.BANDS)])
    monkeypatch.setattr(minhash, "_band_keys", only)
    base = [f"w{i}" for i in range(300)]
    change = lambda at, words=base: [f"x{i}" if i in at else w for i, w in enumerate(words)]
    x = change(range(4, 300, 25))
    rows = [(i, change([i])) for i in range(30)] + [(100, x), (101, change([299], x))]
    rows = [(i, " ".join(words)) for i, words in rows]
    want = plain_components(rows)
    assert set(want.values()) == {0, 100}
    got = minhash.near_duplicates(spark.createDataFrame(rows, edges.SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_on_odd_rows(spark):
    got = minhash.near_duplicates(edges.documents(spark))
    assert edges.same_ids(got)
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect() if r.doc_id is not None]
    assert {i: c for i, _, c, _ in rows} == plain_components([r for r in edges.ROWS if r[1] != edges.LONG]) | {10: 10}
    assert dict((r[0], r[1]) for r in rows)[1] == 0
    (nameless,) = [r for r in got.collect() if r.doc_id is None]
    assert nameless.component_id is None and nameless.kept
    assert minhash.near_duplicates(edges.empty(spark)).count() == 0
    kept = minhash.keep_one_of_each(edges.documents(spark))
    assert kept.columns == edges.documents(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11]


def test_minima_of_a_long_set_are_taken_in_parts(monkeypatch):
    keys, size = minhash.shingle_sets([edges.LONG, "a b c d e f", None])
    whole = minhash.signatures(keys, size)
    monkeypatch.setattr(minhash, "CHUNK", 1000)
    assert (minhash.signatures(keys, size) == whole).all() and size.tolist() == [59_996, 2, 0]


def spread(*words):
    """Texts that share nothing."""
    return [" ".join(f"{w}{i}" for i in range(60)) for w in words]


def test_rows_of_one_id_are_one_node(spark):
    x, y, z = spread("x", "y", "z")
    rows = [(3, x), (5, x), (5, y), (7, y), (9, z), (9, ""), (11, z + " end"), (None, x), (None, x.upper()), (None, "q r s"), (2, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, edges.SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(3, 3), (5, 3), (7, 3), (9, 9), (11, 9), (2, 2)}
    assert sorted(((r.component_id or 0, r.kept) for r in got if r.doc_id is None)) == [(0, True), (3, False), (3, False)]
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_many_texts_of_one_id_join_their_components(spark):
    texts = spread(*(f"t{i}_" for i in range(40)))
    rows = [(1000, t) for t in texts] + [(i, t + " end") for i, t in enumerate(texts, 5)] + [(2000, texts[0]), (2000, "other words of another text")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, edges.SCHEMA)).collect()
    assert {r.component_id for r in got} == {5} and len(got) == len(rows)


def test_one_row_of_each_group_of_texts_stays(spark):
    a, b, c, x, y = spread("a", "b", "c", "x", "y")
    rows = [(1, a), (1, b), (2, c), (3, x), (5, x), (5, y), (7, y), (None, a + " end"), (None, c), (4, ""), (None, "")]
    rows += [(20, x + " end"), (None, "only here"), (None, "only here"), (1, a), (1, b.upper())]
    df = spark.createDataFrame(rows, edges.SCHEMA).selectExpr("*", "map('k', doc_id) AS f1", "array(text) AS row", "'x' AS `group`", "1 AS least")
    kept = minhash.keep_one_of_each(df)
    assert kept.dtypes == df.dtypes
    got = kept.collect()
    texts = sorted((r.doc_id or 0, (r.text or "").lower()) for r in got)
    assert texts == sorted([(1, a), (1, b), (2, c), (3, x), (5, y), (4, ""), (0, ""), (0, "only here")])
    assert all(r.row == [r.text] and r.f1 == {"k": r.doc_id} for r in got)
    again = minhash.keep_one_of_each(df.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


@pytest.mark.parametrize("most", [0, None, 10**6])
def test_few_edges_are_not_shuffled(spark, folder, monkeypatch, most):
    if most == 0:
        monkeypatch.setattr(components_of, "ONE_TASK", 0, raising=False)
    r, n = random.Random(9), 300
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(220)] + [(None, 1), (2, None)] + [(n + i, n + i + 1) for i in range(40)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    root = {i: i for i in range(n + 41)}
    for _ in range(n):
        for a, b in pairs:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.u: r.v for r in components(edges, f"{folder}/c", most or None).collect()}
    assert got == {u: v for u, v in root.items() if u != v}
    plan = components_of._large_star(spark.read.parquet(f"{folder}/c/0"), 300)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (most == 0)
