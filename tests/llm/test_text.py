from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import words
from ledgerflow.llm.blocks import deltas, pack, unpack
from ledgerflow.llm.text import U64, Words, inside, ngrams, pieces, utf8

import numpy as np

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\v\f\r\x1c\xa0　中\U0001f600", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans())
def test_words_and_hashes(texts, lower):
    w = Words(*utf8(pa.array(texts, pa.string())), lower=lower)
    data = w.data.tobytes()
    got = [[data[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)]
           for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(t) for t in texts]
    assert w.code_points().tolist() == [sum(map(len, words(t))) for t in texts]
    named = {}
    flat = [x for t in texts for x in words(t, lower)]
    for h, x in zip(w.hashes().tolist(), flat, strict=True):
        assert named.setdefault(x, h) == h
    assert len(set(named.values())) == len(named)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_ngrams_inside_rows(texts, n):
    w = Words(*utf8(pa.array(texts, pa.string())), lower=False)
    ok = inside(w.first, n)
    rows = [words(t) for t in texts]
    want = [tuple(r[i:i + n]) for r in rows for i in range(len(r) - n + 1)]
    grams = ngrams(w.hashes(), n)[ok] if len(ok) else []
    assert len(grams) == len(want)
    assert len(set(zip(want, list(map(int, grams)), strict=True))) == len(set(want)) == len(set(map(int, grams)))


def test_pieces_cover_all_rows_within_the_bound():
    batch = pa.record_batch([pa.array(["x" * n if n is not None else None for n in (5, 0, None, 3, 100, 1, 1, 9)])], names=["t"])
    parts = list(pieces(iter([batch, batch.slice(3), batch.slice(0, 0)]), 0, 10))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() + batch.slice(3).column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 10 for p in parts)


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.int64) - 2, np.zeros(0, U64), np.array([1, 2], np.uint8), np.array([0.5]),
              np.array([1 << 63], U64), np.arange(3, dtype=np.int32)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 50).astype(U64) * U64(2))
    assert np.cumsum(deltas(keys), dtype=U64).tolist() == keys.tolist()
    assert unpack(pack()) == []
