"""Substring dedup by super-k-mer partitioning.

A window is a run of consecutive words. Its minimiser is the smallest hash among the short
word runs in it. Consecutive windows with one minimiser travel as one packed string (a
super-k-mer) to the bucket of that minimiser, so equal windows always meet. Equal strings
of a block of documents travel once. In a bucket all windows are sorted; the smallest
doc_id of each distinct window goes back to the blocks that hold the window in a document
with a larger one. There the covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.blocks import Block, exchange, grouped, pack, runs, to_blocks, unpack
from ledgerflow.llm.common import documents, partitions_for
from ledgerflow.llm.text import U64, Words, inside, mix, ngrams, powers

WINDOW = 13
#: Words of the runs among which the minimiser is chosen.
MINIMISER = 3
#: Text bytes of the documents per bucket of super-k-mers (their strings are about three times as long).
BUCKET_BYTES = 2 << 20
_BASE = 0xD1342543DE82EF95


class Normal:
    """The words of a block joined by single spaces, with their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=False)
        self.first, self.row = words.first, words.rows()
        self.hash = words.hashes()
        length = words.ends - words.starts
        self.end = np.cumsum(length + 1) - 1  # the place after each word
        self.start = self.end - length
        at = np.repeat(self.start - words.starts, length) + np.flatnonzero(~words._space)
        self.data = np.full(int(self.end[-1]) + 1 if len(length) else 0, 32, np.uint8)
        self.data[at] = data[~words._space]


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values, by doubling."""
    if len(a) < n:
        return a[:0]
    width = 1
    while 2 * width <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    rest = n - width
    return np.minimum(a[:len(a) - rest], a[rest:]) if rest else a


def super_kmers(text: Normal, skip: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows (rows of ``skip`` have none)."""
    n = len(text.hash) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U64)
    valid = inside(text.first, window) & ~skip[text.row[:n]]
    least = sliding_min(ngrams(text.hash, k), window - k + 1)
    row = text.row[:n]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    bound = np.zeros(n + 1, np.int64)
    np.cumsum(valid, out=bound[1:])
    until = np.append(first[1:], n)
    return first, bound[until] - bound[first], least[first]


class Entries:
    """The distinct super-k-mers of a block, in the order met, and the entry of each occurrence."""

    def __init__(self, block: Block, window: int, k: int):
        self.text = Normal(block.data, block.offsets)
        self.first, self.windows, least = super_kmers(self.text, block.null, window, k)
        raw = self.text.data.tobytes()
        known: dict[bytes, int] = {}
        start = self.text.start[self.first].tolist()
        end = self.text.end[self.first + self.windows + window - 2].tolist() if len(self.first) else []
        self.entry = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start, end, strict=True)),
                                 np.int64, len(start))
        self.strings = list(known)
        self.doc = block.ids[self.text.row[self.first]]
        self.minimiser = np.zeros(len(known), U64)
        self.minimiser[self.entry] = least
        self.low = np.full(len(known), np.iinfo(np.int64).max)
        self.high = np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.entry, self.doc)
        np.maximum.at(self.high, self.entry, self.doc)


def _send(batches: Iterator[pa.RecordBatch], window: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            e = Entries(Block(payload), window, k)
            bucket = (mix(e.minimiser) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, b in runs(bucket[order]):
                some = order[a:b]
                strings = [e.strings[i] for i in some.tolist()]
                lengths = np.fromiter(map(len, strings), np.int32, len(strings))
                yield pa.record_batch([pa.array([int(bucket[some[0]])]), pa.array([number]), pa.array(
                    [pack(some.astype(np.int32), lengths, e.low[some], e.high[some],
                          np.frombuffer(b"".join(strings), np.uint8))], pa.binary())],
                    names=["bucket", "block", "payload"])


def _window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of packed strings: its string, its place in it, and two independent 64-bit hashes."""
    words = Words(data, offsets, lower=False)
    ok = inside(words.first, window)
    at = np.flatnonzero(ok)
    one = ngrams(words.hashes(), window)[at] if len(at) else np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(mix(data.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=total[1:])
    start, end = words.starts[at], words.ends[at + window - 1]
    two = (total[end] - total[start]) * powers(pow(_BASE, -1, 1 << 64), max(len(data), 1))[start]
    row = words.rows()[at]
    return row, at - words.first[row], one, two


def _meet(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: sort all windows; answer each block with the windows that a smaller doc_id has too."""
    for _, rows in grouped(batches):
        entry, block, low, high, parts = [], [], [], [], []
        base = 0
        for i, (_, _, payload) in enumerate(rows):
            numbers, lengths, lo, hi, data = unpack(payload)
            offsets = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            row, place, one, two = _window_hashes(data, offsets, window)
            parts.append((row + base, place, one, two))
            entry.append(numbers)
            block.append(np.full(len(numbers), i))
            low.append(lo)
            high.append(hi)
            base += len(numbers)
        row, place, one, two = (np.concatenate(c) for c in zip(*parts, strict=True))
        entry, block, low, high = map(np.concatenate, (entry, block, low, high))
        order = np.argsort(one, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = np.empty(len(order), np.int64)
        if len(order):
            group = np.cumsum(new) - 1
            least[order] = np.minimum.reduceat(low[row[order]], np.flatnonzero(new))[group]
        hit = np.flatnonzero(least < high[row])
        if not len(hit):
            continue
        # Windows are in order of string and place: join neighbours with one answer into ranges.
        r, p, d = row[hit], place[hit], least[hit]
        begin = np.ones(len(hit), bool)
        begin[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1])
        s = np.flatnonzero(begin)
        n = np.diff(np.append(s, len(hit)))
        r, p, d = r[s], p[s], d[s]
        of = block[r]
        for a, b in runs(of):
            yield pa.record_batch([pa.array([rows[of[a]][1]]), pa.array([0], pa.int32()), pa.array([pack(
                entry[r[a:b]].astype(np.int32), p[a:b].astype(np.int32), n[a:b].astype(np.int32), d[a:b])],
                pa.binary())], names=["block", "part", "payload"])


def _remove(batches: Iterator[pa.RecordBatch], window: int, k: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Per block: its answers, then the block itself."""
    for _, rows in grouped(batches):
        block = Block(rows[-1][2])
        e = Entries(block, window, k)
        gone = np.zeros(len(e.text.hash) + 1, np.int64)
        by_entry = np.argsort(e.entry, kind="stable")
        begin = np.searchsorted(e.entry[by_entry], np.arange(len(e.strings) + 1))
        for _, _, payload in rows[:-1]:
            entry, place, n, least = unpack(payload)
            # Every answer meets every occurrence of its entry.
            times = begin[entry + 1] - begin[entry]
            which = np.repeat(np.arange(len(entry)), times)
            step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            run = by_entry[begin[entry][which] + step]
            hit = e.doc[run] > least[which]
            first = e.first[run[hit]] + place[which[hit]]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + n[which[hit]] + window - 1, -1)
        gone = np.cumsum(gone[:-1]) > 0
        text = e.text
        counts = np.diff(text.first)
        removed = np.bincount(text.row[gone], minlength=len(counts))
        stay = np.repeat(~gone, text.end - text.start + 1) if len(gone) else np.zeros(0, bool)
        data = text.data[stay]
        at = np.zeros(len(stay) + 1, np.int64)
        np.cumsum(stay, out=at[1:])
        raw = data.tobytes()
        border = np.append(text.start, len(text.data))[text.first]
        kept = [raw[a:max(a, b - 1)] for a, b in zip(at[border[:-1]].tolist(), at[border[1:]].tolist(), strict=True)]
        columns = [pa.array(block.ids, mask=block.null), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(pa.array([x.decode("utf-8", "replace") for x in kept]))
            names.append("kept_text")
        yield pa.record_batch(columns, names=names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     minimiser: int = MINIMISER, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per row of ``docs``.

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id; windows are those of the input. The first document of a passage keeps it. Null text has no
    words; texts shorter than a window are kept whole. Rows with a null doc_id neither lose words nor make
    others lose any. Rows with one doc_id are one document (they never remove each other's words). An
    empty table gives no rows; other columns are not read. Kept words are joined by one space."""
    spark = docs.sparkSession
    if not 1 <= minimiser <= window:
        raise ValueError("minimiser must be between 1 and the window")
    blocks = to_blocks(documents(docs, id_col, text_col), F.lit(0), "blocks")
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    sent = blocks.select("block", "payload").mapInArrow(
        lambda it: _send(it, window, minimiser, buckets), "bucket long, block long, payload binary")
    parts = partitions_for(spark, size, 4 * BUCKET_BYTES)
    answers = exchange(sent, parts, "bucket", "block").mapInArrow(
        lambda it: _meet(it, window), "block long, part int, payload binary")
    both = answers.union(blocks.select("block", F.lit(1).alias("part"), "payload"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return exchange(both, parts, "block", "part").mapInArrow(
        lambda it: _remove(it, window, minimiser, texts), schema)
