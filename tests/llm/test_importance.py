from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.llm import importance as im
from llm_helpers import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, least, most):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, least=1, most=1, buckets=10_000, percent=10, min_words=20):
    source = collections.Counter(bucket(f, buckets) for _, t in docs for f in features(t, least, most)[1])
    wanted = collections.Counter(bucket(f, buckets) for t in target for f in features(t, least, most)[1])
    s, t = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, fs = features(text, least, most)
        weight = sum(gain[bucket(f, buckets)] for f in fs) // max(1, len(fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32))), None, len(words)])
    ready = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(ready[:percent * len(ready) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"least": 1, "most": 3, "buckets": 500, "percent": 50, "min_words": 1},
                                     {"least": 2, "most": 2, "buckets": 64, "percent": 100, "min_words": 0}])
def test_edge_rows_against_brute_force(spark, edge, options):
    """Nulls, empty texts, a repeated id, repeated rows and a null id, with clashing columns."""
    target = spark.createDataFrame([("The quick brown fox",), (None,), ("",), ("lazy DOG été 中文",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = im.resample(edge, target, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert rows_of(got) == brute(docs, [r[0] for r in target.collect()], **options)


def test_whole_small_table_against_brute_force(spark, small):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got = rows_of(im.resample(small, target))
    assert got == brute(docs, [r["text"] for r in target.collect()])
    ready = sum(len(features(t, 1, 1)[0]) >= 20 for _, t in docs)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, ready // 10 + 1))


def test_rows_that_repeat_have_ranks_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(0, 400, 1, 8).selectExpr("id % 2 as doc_id", f"'{text}' as text")
    got = im.resample(docs, spark.createDataFrame([("w1 w2",)], "text string"), percent=50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 201))
    assert {r["doc_id"] for r in got.where("rank is not null").collect()} == {got.orderBy("rank").where("rank = 1").first()["doc_id"]}


def test_empty_tables(spark, none, edge):
    target = spark.createDataFrame([("a b",)], "text string")
    assert im.resample(none, target).collect() == []
    assert im.resample(edge, target.limit(0)).count() == edge.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 199), st.integers(1, 70)), max_size=60), st.data())
def test_sums_of_planes_are_exact(cells, data):
    gain = np.array(data.draw(st.lists(st.integers(-40_000, 40_000), min_size=200, max_size=200)), np.int64)
    row = np.array([r for r, _, n in cells for _ in range(n)], np.int64)
    at = np.array([b for _, b, n in cells for _ in range(n)], np.int64)
    want = np.bincount(row, weights=gain[at], minlength=5).astype(np.int64) if len(row) else np.zeros(5, np.int64)
    assert im.sums(at, row, 5, im.signed_planes(gain), 200).tolist() == want.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=150), min_size=1, max_size=8))
def test_crc32_of_ranges(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert im.crc32(data, starts, ends).tolist() == [zlib.crc32(p) for p in parts]
    first = np.array([zlib.crc32(b"before")] * len(parts), np.uint32)
    assert im.crc32(data, starts, ends, first).tolist() == [zlib.crc32(b"before" + p) for p in parts]
