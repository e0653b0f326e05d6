from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import fingerprints as fp
from ledgerflow.llm.text import U64, Words, mix, utf8
from llm_helpers import words


def plain_print(text, bins=fp.BINS, bits=fp.BITS, k=fp.SHINGLE):
    """The fingerprint bin by bin, from the hashes of the text's shingles."""
    value, _ = fp.shingles(Words(*utf8(pa.array([text])), lower=True), k)
    if not len(value):
        return ""
    have = {}
    for v in mix(value ^ U64(0x8EBC6AF09C88C6E3)).tolist():
        b = v >> (65 - bins.bit_length())
        have[b] = min(v, have.get(b, v))
    order = fp.orders(bins)[0]
    full = [have[b] if b in have else have[next(c for c in order[b].tolist() if c in have)] for b in range(bins)]
    mixed = mix(np.array(full, U64) ^ fp.salts(bins)).tolist()
    return "".join(f"{v % 2**bits:0{bits}b}" for v in mixed)


def as_bits(hexed):
    return "".join(f"{int(c, 16):04b}" for c in hexed)


def shingle_set(text, k=fp.SHINGLE):
    w = words(text, lower=True)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def like(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(docs):
    """(doc_id, n_chars, edited text, next text) in the order of ids; the texts of one id by their hashes."""
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[:len(text) - half] + following[:half], following))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, df):
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    docs = [tuple(r) for r in df.select("doc_id", "text").orderBy(*order).collect()]
    got = fp.fingerprint_pairs(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    want = brute(docs)
    assert sorted((repr(r[0]), r[1], r[2]) for r in got) == sorted((repr(i), len(t), sha(e)) for i, t, e, _ in want)
    prints = {(repr(i), sha(e)): (plain_print(t), plain_print(e), t, e, n) for i, t, e, n in want}
    errors = []
    for r in got:
        one, two, text, changed, following = prints[repr(r["doc_id"]), r["edited_sha256"]]
        assert as_bits(r["fingerprint"]) == one and as_bits(r["edited_fingerprint"]) == two
        for value, other in ((r["near_edited"], changed), (r["near_next"], following)):
            assert 0 <= value <= 1
            a, b = plain_print(text), plain_print(other)
            if not a or not b:
                assert value == float(a == b)
                continue
            same = sum(a[i:i + fp.BITS] == b[i:i + fp.BITS] for i in range(0, len(a), fp.BITS)) / fp.BINS
            assert value == pytest.approx(min(1, max(0, (same - 2**-fp.BITS) / (1 - 2**-fp.BITS))))
            errors.append(value - like(text, other))
    return errors


def test_edge_rows_against_brute_force(spark, edge):
    check(spark, edge.repartition(5))


def test_small_table_against_brute_force_and_true_similarity(spark, small):
    errors = np.array(check(spark, small.repartition(4)))
    assert abs(errors.mean()) < 0.01 and np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25


def test_equal_texts_have_equal_prints_and_likeness_one(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(i, text) for i in range(9)], "doc_id long, text string")
    rows = fp.fingerprint_pairs(df).collect()
    assert len({r["fingerprint"] for r in rows}) == 1 and {r["near_next"] for r in rows} == {1.0}


def test_empty_table_lone_row_and_columns_of_nulls(spark, none):
    assert fp.fingerprint_pairs(none).collect() == []
    lone = fp.fingerprint_pairs(spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in lone] == [(3, 15, 1.0)]
    void = fp.fingerprint_pairs(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")).collect()
    assert [(r["fingerprint"], r["near_edited"], r["near_next"]) for r in void] == [("", 1.0, 1.0)] * 2


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8, 0.95])
@pytest.mark.parametrize("size", [20, 400, 5_000])
def test_likeness_is_unbiased(share, size):
    """Sets of shingles (words, k = 1) of a known similarity, few and many against the number of bins."""
    rng = np.random.default_rng(size)
    common = round(size * 2 * share / (1 + share))
    found = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.choice(10**9, 2 * size - common, replace=False)]
        a, b = w[:size], w[:common] + w[size:]
        p = fp.fingerprints([" ".join(a), " ".join(b)], k=1)
        yes = np.array([True])
        found.append(fp.likeness(p[:1], p[1:], yes, yes)[0])
    assert abs(np.mean(found) - common / (2 * size - common)) < 0.03


def test_few_and_many_bins_fill_alike():
    """Both ways of filling give the first non-empty bin in each bin's own order."""
    rng = np.random.default_rng(3)
    for n in (1, 2, fp.FEW, fp.FEW + 1, 60, 500, 512):
        least = np.full((1, 512), fp._EMPTY)
        least[0, rng.choice(512, n, replace=False)] = rng.integers(0, 2**60, n).astype(U64)
        out = fp.densified(least)[0]
        full = least[0] != fp._EMPTY
        for b in range(512):
            assert out[b] == (least[0, b] if full[b] else least[0, next(c for c in fp.orders(512)[0][b] if full[c])])
