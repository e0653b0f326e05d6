"""Target-distribution importance resampling by bit-sliced aggregation.

Features of a text are runs of consecutive words; a feature's bucket is the crc32 of its bytes modulo
``buckets``. Bucket counts of the whole corpus and of the target texts give each bucket a gain, an integer.
A document's weight is the floored mean of the gains of its features, which is summed bit by bit:

* its bucket counts become bit planes: plane j has bit b set if bit j of the count of bucket b is set;
* the gains become signed bit planes: plane (+, k) has bit b set if the gain of b is positive and bit k of
  it is set, plane (-, k) the same for negative gains;
* the sum of the gains is the sum over j, k and signs of 2**(j + k) times the popcount of the AND of the
  two planes. All of it is integer arithmetic, so the weights are exact.

Weights and a Gumbel variate that a hash of the id fixes make the scores; the highest scores are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks, stored
from ledgerflow.llm.text import U64, Words, pieces, utf8
from ledgerflow.operators.sequence import rank_within_group

BUCKETS = 10_000
#: Documents with fewer words are never drawn; the drawn share, in per cent.
MIN_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bit planes (of all documents) that are counted at a time.
PLANES = 4096

#: Bytes that are in no word: ASCII other than digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not (chr(c).isdigit() or chr(c).isalpha()) for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc.astype(np.uint32)


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of each byte range, going on from the crc32 ``before``: one step a byte position for all ranges at once."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    length = ends - starts
    for i in np.flatnonzero(length > LONG_WORD):
        crc[i] = zlib.crc32(data[starts[i]:ends[i]], int(crc[i]))
    short = np.flatnonzero(length <= LONG_WORD)
    short = short[np.argsort(length[short], kind="stable")]
    at, length = starts[short], length[short]
    state = ~crc[short]
    for p in range(int(length[-1]) if len(length) else 0):
        live = slice(int(np.searchsorted(length, p, side="right")), None)  # ranges with a byte at position p
        state[live] = _CRC[(state[live] ^ data[at[live] + p]) & 0xFF] ^ (state[live] >> 8)
    crc[short] = ~state
    return crc


def features(words: Words, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every run of ``least`` to ``most`` words (joined by a space) of a batch."""
    row = words.rows()
    crc = crc32(words.data, words.starts, words.ends)
    found, rows = [], []
    space = np.array([0x20], np.uint8)
    for n in range(1, most + 1):
        if n > 1:  # the runs of n - 1 words whose next word is in the same row go on by it
            last = np.arange(n - 1, len(row))
            go = row[last - n + 1] == row[last] if len(last) else np.zeros(0, bool)
            crc = crc32(space, np.zeros(len(last), np.int64), np.ones(len(last), np.int64), crc[:len(last)])
            crc = crc32(words.data, words.starts[last], words.ends[last], crc)
        else:
            go = np.ones(len(row), bool)
        if n >= least:
            found.append((crc[go] % np.uint32(buckets)).astype(np.int64))
            rows.append(row[:len(go)][go])
    return np.concatenate(found), np.concatenate(rows)


def _words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    return Words(_LOWER[data], offsets, lower=False, separators=SEPARATORS)


def bucket_counts(texts: DataFrame, least: int, most: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of the one-column ``texts``, summed per task first (``buckets`` rows at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in pieces(batches, 0):
            total += np.bincount(features(_words(part.column(0)), least, most, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: 1000 times the log ratio of the target's and the source's smoothed shares, floored."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k))))
                     for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def bit_planes(group: np.ndarray, position: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative values at (group, position), which ascend and are distinct.

    Returns the planes that have a set bit (rows of 64-bit words), their groups and their powers of two."""
    words = -(-bits // 64)
    planes, groups, powers = [], [], []
    for j in range(int(value.max()).bit_length() if len(value) else 0):
        on = np.flatnonzero((value >> j) & 1)
        if not len(on):
            continue
        g, of = np.unique(group[on], return_inverse=True)
        at = of * words + (position[on] >> 6)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        plane = np.zeros(len(g) * words, U64)
        plane[at[first]] = np.bitwise_or.reduceat(U64(1) << (position[on] & 63).astype(U64), first)
        planes.append(plane.reshape(-1, words))
        groups.append(g)
        powers.append(np.full(len(g), j))
    if not planes:
        return np.zeros((0, words), U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(planes), np.concatenate(groups), np.concatenate(powers)


def signed_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gains' bit planes, their signs and their powers of two."""
    where = np.arange(len(gain))
    up, _, up_power = bit_planes(np.zeros_like(where), where, np.maximum(gain, 0), len(gain))
    down, _, down_power = bit_planes(np.zeros_like(where), where, np.maximum(-gain, 0), len(gain))
    sign = np.concatenate([np.ones(len(up), np.int64), -np.ones(len(down), np.int64)])
    return np.concatenate([up, down]), sign, np.concatenate([up_power, down_power])


def sums(bucket: np.ndarray, row: np.ndarray, rows: int, gain: tuple[np.ndarray, np.ndarray, np.ndarray],
         buckets: int) -> np.ndarray:
    """Sum of the gains of each row's features, from bit planes and popcounts."""
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    planes, of, power = bit_planes(key // buckets, key % buckets, count, buckets)
    out = np.zeros(rows, np.int64)
    for a in range(0, len(planes), PLANES):
        part = planes[a:a + PLANES]
        total = np.zeros(len(part), np.int64)
        for plane, sign, k in zip(*gain, strict=True):
            total += sign * (np.bitwise_count(part & plane).sum(axis=1, dtype=np.int64) << k)
        np.add.at(out, of[a:a + PLANES], total << power[a:a + PLANES])
    return out


def gumbel(doc_id: int | None, seed: str) -> int:
    """The id's share of the score: a Gumbel variate of its hash, in thousandths, floored (null id: of the bare seed)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, least: int, most: int, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)
    planes = docs.sparkSession.sparkContext.broadcast(signed_planes(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            words = _words(part.column(1))
            bucket, row = features(words, least, most, buckets)
            n = np.bincount(row, minlength=part.num_rows)
            weight = sums(bucket, row, part.num_rows, planes.value, buckets) // np.maximum(n, 1)  # floors downwards
            lot = np.array([gumbel(i, seed) for i in part.column(0).to_pylist()], np.int64)
            yield pa.record_batch([part.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.array(n.astype(np.int64)),
                                   pa.array(weight), pa.array(weight + lot)],
                                  names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def cut_score(scores: DataFrame, drawn: int) -> int | None:
    """The ``drawn``-th highest score (None: nothing is drawn).

    Scores are thousandths of logarithms of bounded ratios, so they take some 100,000 values at most, however
    many rows there are: the running sum over a row per value has that bound."""
    if drawn <= 0:
        return None
    for score, n in scores.groupBy("score").count().orderBy(F.col("score").desc()).toLocalIterator():
        drawn -= n
        if drawn <= 0:
            return score
    return None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, one row per row of ``docs``.

    Of the documents with ``min_words`` words or more, ``percent`` per cent (floored) with the highest scores
    are drawn; ``rank`` numbers them from 1, ties to the smaller id, and is null for the others. Null text is
    empty; a text without features has weight 0. Rows that repeat are each scored; rows of one id and score
    rank by weight and features, equal rows in any order. A null id ranks behind others of its score. An empty
    ``target`` gives gains of the source's counts alone; an empty ``docs`` gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.col(target_col).cast("string").alias("text"))
    gain = gains(bucket_counts(plain.select("text"), least, most, buckets), bucket_counts(wanted, least, most, buckets))
    scored = stored(weighted(plain, gain, least, most, seed), "importance")
    ready = scored.where(F.col("n_words") >= min_words)
    drawn = percent * ready.count() // 100
    cut = cut_score(ready, drawn)
    columns = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    may = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    # Equal rows are told apart by their place, so that a row that repeats is still dealt over many tasks.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(),
             F.col("_at").asc()]
    ranked = rank_within_group(scored.where(may).withColumn("_at", F.monotonically_increasing_id()), [], order, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    return (ranked.select(*columns, rank.alias("rank"))
            .unionByName(scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank"))))
