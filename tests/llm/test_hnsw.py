from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import hnsw


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asks, k=5):
    rows = list(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows if i is not None))
    rows = [(i, v) for i, v in rows if good(v)]
    out = {}
    for q, v in rows:
        if asks(q):
            best = sorted((-cosine(v, w), i) for i, w in rows if i != q and len(w) == len(v))
            out.setdefault(q, [(i, -s) for s, i in best][:k])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    """Several shards, recall against all rows, and scores in double precision."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    x = hnsw.unit(np.array([v for _, v in rows], float))
    ids = np.array([i for i, _ in rows])
    got = found(hnsw.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=500))
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        s[at] = -2
        best = set(ids[np.argsort(-s)[:5]].tolist())
        hits += len(best & {i for i, _ in got[q]})
        assert all(score == pytest.approx(s[np.flatnonzero(ids == i)[0]], abs=1e-12) for i, score in got[q])
    assert hits >= 0.95 * 5 * len(asked)


def test_edge_rows_equal_brute_force(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, []), (50, [2.0, 0.0]), (51, [1.0, 0.0]), (52, [1.0, 0.0]), (52, [1.0, 0.0]),
            (53, [0.0, 1.0]), (54, [-1.0, 0.0]), (100, [1.0, 1.0, 1.0]), (101, [1.0, 0.0, 1.0]), (None, [1.0, 0.0]),
            (150, [1e300, 1e300, 1e-300, 1.0]), (55, [1.0, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")) \
        .withColumn("score", F.lit(1))
    asks = F.col("vec_id") % 50 == 0
    got = found(hnsw.nearest(df, asks, shard_rows=4))
    want = {q: b for q, b in brute([r for r in rows if r[0] != 150], lambda i: i % 50 == 0).items() if b}
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert hnsw.nearest(df.limit(0), asks).count() == 0


def test_many_equal_vectors_and_one_crowd():
    """Copies are one node; a crowd of near copies keeps its links to the rest."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(600, 16)), np.ones((400, 16)) + 0.01 * r.normal(size=(400, 16))])
    ids = np.arange(len(x))
    g = hnsw.Graph.build(hnsw.unit(x).astype(np.float32), ids)
    q = hnsw.unit(x[::10])
    got = g.search(q.astype(np.float32), 64)[:, :6]
    s = q @ hnsw.unit(x).T
    kth = np.sort(s, axis=1)[:, -6]
    assert np.mean([(s[i][got[i]] >= kth[i] - 1e-6).mean() for i in range(len(q))]) > 0.95
    assert all((layer[i] != i).all() for layer in g.layers for i in range(len(x)))


def test_copies_with_ties_go_to_the_smaller_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(i, [float(i), 1.0]) for i in range(300, 320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=50))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("shard_rows", [4, 200])
def test_very_large_and_small_vectors(spark, shard_rows):
    """Cosines do not depend on the length of the vectors, from the smallest to the largest doubles."""
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 6))
    factor = 10.0 ** r.choice([-300, -200, 0, 200, 300], 60)
    rows = [(i, (v * f).tolist()) for i, (v, f) in enumerate(zip(base, factor, strict=True))] + [(60, [5e-324] * 6), (61, [1.7e308] * 6)]
    plain = [(i, v.tolist()) for i, v in enumerate(base)] + [(60, [1.0] * 6), (61, [1.0] * 6)]
    got = found(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0,
                             shard_rows=shard_rows))
    want = brute(plain, lambda i: i % 10 == 0)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_scaling_keeps_every_bit():
    x = np.random.default_rng(2).normal(size=(50, 8)) * 10.0 ** np.arange(-20, 30)[:, None]
    y = hnsw.scaled(x)
    assert (np.abs(y).max(axis=1) < 1).all() and (np.abs(y).max(axis=1) >= 0.5).all()
    assert (np.frexp(x)[0] == np.frexp(y)[0]).all()
