from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import as_rows, words  # noqa: F401
from ledgerflow.llm import quality
from ledgerflow.llm.text import Words, utf8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


@pytest.mark.parametrize("table", ["edge", "small"])
def test_base_columns(request, spark, table):
    docs = request.getfixturevalue(table)
    good = spark.createDataFrame([(1,), (1,), (None,), (10,), (7,)], "g long")
    out = quality.quality_rules(docs, good).select("doc_id", "text", *[f"quality.{c}" for c in BASE]).collect()
    assert len(out) == docs.count()
    assert all(tuple(r)[2:] == base(r["text"]) for r in out)


def test_log_ratio_is_that_of_the_two_multinomials(spark, small):
    """The score of every document from plain counts of hashed n-grams."""
    rows = small.select("doc_id", "text").collect()
    bits = 12
    keys = {}
    for r in rows:
        found = Words(*utf8(pa.array([r["text"]])), lower=True)
        keys[r["doc_id"]] = quality.features(found, bits)[0].tolist()
    trusted = [i for i in keys if i % 3 == 0]
    counted = [i for i in trusted if zlib.crc32(str(i).encode()) % 2 == 0]
    raw = collections.Counter(k for ks in keys.values() for k in ks)
    good = collections.Counter(k for i in counted for k in keys[i])

    total = {id(c): sum(c.values()) for c in (raw, good)}

    def log_p(c, k):
        add = quality.SMOOTHING * total[id(c)] / 2**bits
        return math.log((c[k] + add) / (total[id(c)] + add * 2**bits))

    out = quality.quality_rules(small, spark.createDataFrame([(i,) for i in trusted], "g long"), bits=bits).collect()
    scores = {}
    for r in out:
        ks = keys[r["doc_id"]]
        want = sum(log_p(good, k) - log_p(raw, k) for k in ks) / max(1, len(ks))
        assert r["quality"]["llr"] == pytest.approx(want, abs=1e-5)
        scores[r["doc_id"]] = r["quality"]
    left_out = sorted(scores[i]["llr"] for i in trusted if i not in counted and not scores[i]["base_failed"])
    threshold = left_out[int(quality.UNREACHED * len(left_out))] - quality.MARGIN
    for q in scores.values():
        if abs(q["llr"] - threshold) > 2 * quality.GRID:
            assert q["kept"] == (not q["base_failed"] and q["llr"] > threshold)


def test_labelled_documents_fall_on_the_right_side(spark):
    from ledgerflow.llm.queries import op2_quality_rules

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = op2_quality_rules(spark, "/root/testdata/sf0.1").where("not base_failed").join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)]
    assert n[(0, False)] >= 0.98 * (n[(0, False)] + n.get((0, True), 0))


def test_no_trusted_text_and_no_rows(spark, edge, none):
    nobody = spark.createDataFrame([], "g long")
    out = quality.quality_rules(edge, nobody).select("quality.*").collect()
    assert all(r["llr"] == 0 and r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.quality_rules(none, nobody).count() == 0


def test_kept_rows_keep_all_columns(spark, edge):
    good = spark.createDataFrame([(1,)], "g long")
    out = quality.kept_documents(edge, good)
    assert out.schema == edge.schema
    want = [r for r in edge.collect() if not base(r["text"])[5]]
    assert 0 < out.count() <= len(want)


def test_repeated_words_across_rows_do_not_count():
    found = Words(*utf8(pa.array(["a b c d e f g h", "a b c d e f g h", "a b c d e f g h a b c d e f g h"])), lower=False)
    assert np.array_equal(quality.repeated_words(found, 8), [0, 0, 16])
