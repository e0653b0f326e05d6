from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from llm_helpers import words
from ledgerflow.llm import interpolation as lm


def model_rows(rows, order, weights):
    """Scores from plain counters, with the weights that were learned."""
    tokens = [(i, words(t, True) + ["\0end"]) for i, t in rows]
    part = [zlib.crc32(str(i).encode()) % 10 if i is not None else 0 for i, _ in tokens]
    train = [w for (_, w), p in zip(tokens, part, strict=True) if p]
    counts = [None] + [collections.Counter() for _ in range(order)]
    for w in train:
        for n in range(1, order + 1):
            padded = ["\0begin"] * (n - 1) + w
            counts[n].update(tuple(padded[j:j + n]) for j in range(len(w)))
    total, types = sum(counts[1].values()), len(counts[1])
    out = []
    for (i, w), p in zip(tokens, part, strict=True):
        base = sum(math.log10((counts[1][(x,)] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        score = 0.0
        for j in range(len(w)):
            estimates, kind = [1 / (types + 1), counts[1][(w[j],)] / max(1, total)], 0
            for n in range(2, order + 1):
                padded = ["\0begin"] * (n - 1) + w
                context = tuple(padded[j:j + n - 1])
                seen = len(train) if set(context) == {"\0begin"} else counts[n - 1][context]
                estimates.append(counts[n][tuple(padded[j:j + n])] / max(seen, 1))
                if seen:
                    kind = 64 * (n - 1) + math.ceil(math.log2(seen + 1))
            score += math.log10(sum(a * b for a, b in zip(lm._weights_of(kind, weights, order), estimates, strict=True)))
        out.append((i, p == 0, len(w), sum(counts[1][(x,)] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize(("table", "order", "bucket"), [
    ("edge", 2, lm.BUCKET_BYTES), ("edge", 3, 50_000), ("small", 2, 20_000), ("small", 3, lm.BUCKET_BYTES)])
def test_scores_equal_plain_counts(request, monkeypatch, table, order, bucket):
    docs = request.getfixturevalue(table)
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
    learned = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: learned.update(learn(*a, **k)) or learned)
    got = sorted((tuple(r) for r in lm.score_texts(docs, order=order).collect()), key=repr)
    want = sorted(model_rows([(r["doc_id"], r["text"]) for r in docs.collect()], order, learned), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)


def test_keys_grow_with_the_text_and_buckets_are_ranges():
    assert [lm.keys_for(3, size).bits for size in (0, 1 << 20, 1 << 29, 1 << 35, 10**14)] == [32, 45, 54, 60, 64]
    names = lm.Keys(2, 7, 45)
    for n, bits in ((1, 64), (2, 45)):
        keys = np.array([0, 1, (1 << bits) // 7 - 9, 1 << (bits - 1), (1 << bits) - 1], np.uint64)
        assert names.ranges(n, keys).tolist() == [7 * (n - 1) + b for b in (0, 0, 0, 3, 6)]


def test_weights_are_those_of_plain_em(spark):
    rows = [(65, 0.1, 0.5, 30), (65, 0.1, 0.0, 20), (65, 0.01, 0.9, 50), (0, 0.2, 0.0, 7)]
    held = spark.createDataFrame(rows, "kind long, p1 double, p2 double, n long")
    got = lm.learn_weights(held, 2, 0.001, steps=5)
    w = [1 / 3] * 3
    for _ in range(5):
        new = [0.0] * 3
        for kind, p1, p2, n in rows:
            if kind == 65:
                parts = [w[0] * 0.001, w[1] * p1, w[2] * p2]
                new = [a + n * b / sum(parts) for a, b in zip(new, parts, strict=True)]
        w = [a / 100 for a in new]
    assert got[65] == pytest.approx(w, abs=1e-6)
    assert got[0][2] == 0 and sum(got[0]) == pytest.approx(1)


def test_model_beats_the_unigram_score_on_held_out_text(spark):
    from ledgerflow.llm.queries import op1_deleted_interpolation

    r = (op1_deleted_interpolation(spark, "/root/testdata/sf0.01").where("held_out")
         .selectExpr("sum(score) as score", "sum(base_score) as base").first())
    assert r["score"] > 0.9 * r["base"]


def test_no_rows_and_no_training_text(spark, none):
    assert lm.score_texts(none).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm.score_texts(only).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert r["base_score"] == 0 and r["score"] == pytest.approx(0, abs=1e-9)


def test_registered_query_uses_trigrams(spark, small):
    from ledgerflow.llm.queries import op1_deleted_interpolation

    got = {r["doc_id"]: r["score"] for r in op1_deleted_interpolation(spark, "/root/testdata/sf0.001").collect()}
    want, less = ({r["doc_id"]: r["score"] for r in lm.score_texts(small, order=n).collect()} for n in (3, 2))
    assert got == pytest.approx(want, rel=1e-9) and got != pytest.approx(less, rel=1e-3)
