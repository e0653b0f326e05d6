from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from llm_helpers import words
from ledgerflow.llm import substrings


def brute(rows, window):
    low = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for j in range(len(w) - window + 1):
                key = tuple(w[j:j + window])
                low[key] = min(i, low.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        if i is not None:
            for j in range(len(w) - window + 1):
                if low[tuple(w[j:j + window])] < i:
                    gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("table", "window", "k"), [("edge", 13, 3), ("edge", 3, 1), ("small", 13, 3)])
def test_words_removed_equal_brute_force(request, table, window, k):
    docs = request.getfixturevalue(table)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert got(substrings.dedup_substrings(docs, window=window, minimiser=k, texts=True)) == want


def test_many_blocks_and_buckets(spark, monkeypatch):
    """Passages over several blocks and buckets, few distinct words, runs of one word."""
    from ledgerflow.llm import blocks

    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    write = blocks.to_blocks
    monkeypatch.setattr(substrings, "to_blocks", lambda d, kind, name: write(d, kind, name, max_bytes=3000))
    r = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = [r.choice("abcdefg") for _ in range(r.randint(0, 60))]
        if i % 3:
            at = r.randint(0, 20)
            w[at:at] = passage[r.randint(0, 10):r.randint(20, 40)]
        if i % 7 == 0:
            w += ["x"] * 30
        rows.append((r.randint(0, 100), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(substrings.dedup_substrings(df, texts=True)) == brute(rows, 13)


def test_sliding_minimum():
    a = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 11, 200):
        assert substrings.sliding_min(a, n).tolist() == [a[i:i + n].min() for i in range(len(a) - n + 1)]
    assert len(substrings.sliding_min(a[:3], 4)) == 0


def test_no_rows(none):
    assert substrings.dedup_substrings(none).count() == 0
