"""Document fingerprints: one-permutation MinHash, optimally densified, with packed low-order bits.

Each shingle of a text is hashed once. The top bits of the hash name its bin, and a bin keeps its smallest hash.
An empty bin takes the value of the first non-empty bin in an order of its own: a pseudo-random permutation of
the bins that is the same for all texts, so that the bins of two texts agree with the probability of their
similarity. Of each bin's value, mixed with the bin's number, the low-order ``BITS`` are stored. Two different values agree in these with probability
2**-BITS, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks, stored
from ledgerflow.llm.text import U64, Words, inside, mix, ngrams, pieces, utf8

#: Bins (a power of two), stored bits of each, words of a shingle.
BINS, BITS, SHINGLE = 512, 4, 5
#: Texts that are worked on at a time (their bins take 8 bytes each).
ROWS = 1024
#: Texts with so few non-empty bins choose among them directly, others try bins one after another.
FEW = 22
_EMPTY = U64(2**64 - 1)


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bin a permutation of the bins, and each bin's place in it."""
    order = np.argsort(mix(np.arange(1, bins * bins + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(bins, bins), axis=1)
    return order, np.argsort(order, axis=1)


_orders_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    if bins not in _orders_of:
        _orders_of[bins] = _orders(bins)
    return _orders_of[bins]


def salts(bins: int) -> np.ndarray:
    return np.arange(1, bins + 1, dtype=U64) * U64(0xD1342543DE82EF95)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each ``k``-word shingle of a batch; a row with fewer words is one shingle of all of them."""
    h, first = words.hashes(), words.first
    count, row = np.diff(first), words.rows()
    ok = np.flatnonzero(inside(first, k))
    short = np.flatnonzero((count > 0) & (count < k))
    one = [ngrams(h[first[i]:first[i + 1]], int(count[i]))[0] ^ U64(int(count[i]) * 0xA0761D6478BD642F % 2**64) for i in short]
    return np.concatenate([ngrams(h, k)[ok] if len(ok) else h[:0], np.array(one, U64)]), np.concatenate([row[ok], short])


def densified(least: np.ndarray) -> np.ndarray:
    """``least`` (texts x bins) with the empty bins of each text that has any other filled."""
    out, bins = least.copy(), least.shape[1]
    order, place = orders(bins)
    full = least != _EMPTY
    count = full.sum(axis=1)
    for t in np.flatnonzero((count > 0) & (count <= FEW)):
        have = np.flatnonzero(full[t])
        out[t] = np.where(full[t], least[t], least[t, have[np.argmin(place[:, have], axis=1)]])
    text, empty = np.nonzero(~full & (count > FEW)[:, None])
    for attempt in range(bins):
        if not len(text):
            break
        source = order[empty, attempt]
        hit = full[text, source]
        out[text[hit], empty[hit]] = least[text[hit], source[hit]]
        text, empty = text[~hit], empty[~hit]
    return out


def fingerprints(texts: list[str], k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Packed fingerprints (rows of bytes) of texts; all zero for a text without words."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    words = Words(data, offsets, lower=True)
    value, row = shingles(words, k)
    value = np.minimum(mix(value ^ U64(0x8EBC6AF09C88C6E3)), _EMPTY - U64(1))
    least = np.full(len(texts) * bins, _EMPTY)
    np.minimum.at(least, row * bins + (value >> U64(64 - bins.bit_length() + 1)).astype(np.int64), value)
    kept = densified(least.reshape(-1, bins))
    # The bits kept of a value differ from bin to bin: else two values that agree in them would do so in all their bins.
    kept = mix(kept ^ salts(bins))
    kept[np.diff(words.first) == 0] = 0
    low = (kept & U64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(texts), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity (0 to 1) of the texts behind rows of fingerprints.

    ``some_a``, ``some_b``: has the text words? Texts without words are like one another and like no other."""
    bins = a.shape[1] * 8 // bits
    same = np.unpackbits(a ^ b, axis=1).reshape(len(a), bins, bits).any(axis=2)
    by_chance = 2.0 ** -bits
    share = ((1 - same.sum(axis=1) / bins) - by_chance) / (1 - by_chance)
    return np.where(some_a & some_b, np.clip(share, 0.0, 1.0), (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    """The last half of the code points (floored) replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_DONE = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("print", pa.binary()),
         ("edited_print", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DONE_SQL = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], k: int, bins: int, bits: int) -> list[pa.Array]:
    """The columns ``_DONE`` of texts and those that follow them. Prints of texts without words are empty."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    # Most texts follow one another: each is hashed once, and once more as edited.
    at = {t: i for i, t in enumerate(dict.fromkeys([*texts, *following, *changed]))}
    prints = np.zeros((len(at), bins * bits // 8), np.uint8)
    every, a, size = list(at), 0, 0
    for b, t in enumerate(every):
        size += len(t)
        if size > 2 << 20 or b - a >= ROWS or b + 1 == len(every):
            prints[a:b + 1] = fingerprints(every[a:b + 1], k, bins, bits)
            a, size = b + 1, 0
    some = np.array([bool(t.strip(" \t\n\v\f\r")) for t in every], bool)
    one, two, three = (np.array([at[t] for t in x], np.int64) for x in (texts, changed, following))

    def packed(which: np.ndarray) -> pa.Array:
        return pa.array([prints[i].tobytes() if some[i] else b"" for i in which], pa.binary())

    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), packed(one), packed(two),
            pa.array(likeness(prints[one], prints[two], some[one], some[two], bits)),
            pa.array(likeness(prints[one], prints[three], some[one], some[three], bits))]


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    The next document is the one of the next higher id, after the last the first; the edited text is made with it
    (``edited``). Fingerprints are hexadecimal; equal texts have equal ones. Words are lower-cased in A-Z. Null text
    is empty; texts without words have an empty fingerprint, likeness 1 to one another and 0 to others. A null id is
    before all others; rows of one id follow one another by a hash of their texts. A lone row is its own next. An
    empty table gives no rows; other columns are not read.

    Rows are dealt over ranges of ids and sorted there, so the next row is at hand; the first and last row of each
    range (two rows a partition) are set aside and joined afterwards.
    """
    python_tasks(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows of one id are told apart, so that an id that repeats often is dealt over many ranges.
    keyed = plain.withColumn("_hash", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "_at"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("pid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pid = None, None

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            nothing = [pa.nulls(1, t) for _, t in _DONE[1:]]
            return pa.record_batch([pa.array([doc_id], pa.int64()), *nothing, pa.array([kind]), pa.array([pid], pa.int64()),
                                    pa.array([text])], names=out_names)

        for part in pieces(batches, 1):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            if held is None:
                pid = part.column(2)[0].as_py()
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            n = len(ids) - 1
            if n:
                done = _compared(ids[:-1], texts[:-1], texts[1:], shingle, bins, bits)
                yield pa.record_batch([*done, pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, pid)), pa.nulls(n, pa.string())],
                                      names=out_names)
        if held is not None:
            yield edge(2, *held)

    out_names = [*(n for n, _ in _DONE), "kind", "pid", "text"]
    made = stored(ranged.mapInArrow(run, f"{_DONE_SQL}, kind long, pid long, text string"), "fingerprints")
    firsts, lasts = made.where("kind = 1"), made.where("kind = 2")
    # One row per range of ids: windows over the ranges' numbers are bounded by the number of partitions.
    every = Window.orderBy("pid")
    following = firsts.select("pid", F.coalesce(F.lead("pid").over(every), F.min("pid").over(Window.partitionBy())).alias("next"))
    ends = (lasts.select("pid", "doc_id", "text").join(following, "pid")
            .join(firsts.select(F.col("pid").alias("next"), F.col("text").alias("following")), "next")
            .select("doc_id", "text", "following"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.record_batch(_compared(*(c.to_pylist() for c in part.columns), shingle, bins, bits), names=[n for n, _ in _DONE])

    columns = [n for n, _ in _DONE]
    whole = made.where("kind = 0").select(*columns).unionByName(ends.mapInArrow(finish, _DONE_SQL))
    return whole.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"),
                        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
