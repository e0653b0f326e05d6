"""LM scoring by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood n-gram estimates (1 to
``order`` words) and the uniform distribution. The mixture weights depend on the longest
context that occurred in training: its length and the frequency class of its count. They
are learned by expectation-maximisation on a part of the training text that is deleted
from the counts for this purpose; the scores use the counts of all training text.

N-grams are counted as 64-bit hashes. A block of documents sends each distinct n-gram it
holds once, with its count, to the bucket of its hash; a bucket adds the counts up and
answers each block with the totals of the n-grams it sent. So a frequent n-gram costs one
entry per block, and no count table is ever broadcast or collected. A bucket is a range of
keys, so the keys a block sends to it lie close together and their differences are short.
Words keep all 64 bits of their hash; n-grams of two words and more keep as many as make
a clash with any other n-gram less likely than one in 2**``SPARE_BITS`` (all 64 from 1 TB on).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.blocks import Block, deltas, exchange, grouped, pack, runs, to_blocks, unpack
from ledgerflow.llm.common import documents, fold, partitions_for, stored
from ledgerflow.llm.text import U64, Words, mix

ORDER = 2
#: Text bytes per bucket of n-grams of one length.
BUCKET_BYTES = 4 << 20
#: Bits of a key beyond those that number the text's bytes (there are fewer n-grams of one length than bytes).
SPARE_BITS = 24
STEPS = 12
#: Kinds of blocks: training text, training text deleted while weights are learned, text not learned from.
KEEP, DELETED, HELD_OUT = 0, 1, 2
_END, _BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Added to every count by the base score.
BASE_ADD = 0.1


class Keys(NamedTuple):
    """How n-grams are named: lengths 1 to ``order``, ``buckets`` of each length, ``bits`` of a key from two words on."""

    order: int
    buckets: int
    bits: int

    def width(self, n: int) -> int:
        return 64 if n == 1 else self.bits

    def ranges(self, n: int, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key of ``n`` words: equal ranges of the keys, numbered on from those of shorter ones."""
        top = keys >> U64(self.width(n) - 32)
        return (n - 1) * self.buckets + (top * U64(self.buckets) >> U64(32)).astype(np.int64)


def keys_for(order: int, size: int) -> Keys:
    """Keys for a corpus of ``size`` bytes."""
    return Keys(order, max(1, -(-size // BUCKET_BYTES)), min(64, max(32, size.bit_length() + SPARE_BITS)))


class Tokens:
    """Token hashes of a block (words in lower case, one end per document) and the n-gram keys at each."""

    def __init__(self, block: Block, names: Keys):
        words = Words(block.data, block.offsets, lower=True)
        rows, h = len(block.ids), words.hashes()
        self.counts = np.diff(words.first) + 1
        self.row = np.repeat(np.arange(rows), self.counts)
        token = np.full(len(h) + rows, _END, U64)
        token[np.arange(len(h)) + words.rows()] = h
        self.first = np.cumsum(self.counts) - self.counts
        place = np.arange(len(token)) - self.first[self.row]
        self.begins = place == 0
        self.names, self.token, self.place = names, token, place.astype(np.int32)

    def keys(self, n: int) -> np.ndarray:
        """The key of the ``n`` tokens that end at each token (made when asked for: one length is held at a time)."""
        token = self.token
        key = np.full(len(token), n * 0x9E3779B97F4A7C15 % (1 << 64), U64)
        for back in range(n - 1, -1, -1):
            then = token
            if back:
                then = np.full(len(token), _BEGIN, U64)
                then[back:] = np.where(self.place[back:] >= back, token[:-back], _BEGIN)
            key = mix(key * U64(0xD6E8FEB86659FD93) + then)
        return key >> U64(64 - self.names.width(n))


def end_key() -> int:
    """The key of the end token as an n-gram of one."""
    return int(mix(np.array([0x9E3779B97F4A7C15], U64) * U64(0xD6E8FEB86659FD93) + _END)[0])


def _send(batches: Iterator[pa.RecordBatch], names: Keys) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a block, by bucket: ascending keys and their counts (0 in text not learned from)."""
    for batch in batches:
        for number, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = Tokens(Block(payload), names)
            for n in range(1, names.order + 1):
                key, count = np.unique(tokens.keys(n), return_counts=True)
                if kind == HELD_OUT:
                    count[:] = 0
                bucket = names.ranges(n, key)
                for a, b in runs(bucket):
                    yield pa.record_batch([
                        pa.array([int(bucket[a])]), pa.array([number]), pa.array([kind], pa.int32()),
                        pa.array([pack(deltas(key[a:b]), count[a:b].astype(np.uint32), level=1)], pa.binary())],
                        names=["bucket", "block", "kind", "payload"])


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: totals of all keys, sent back to each block; for single words also six sums, one a row (block
    -1 to -6, the sum in place of the bucket's number)."""
    end = U64(end_key())
    for bucket, rows in grouped(batches):
        sent = [unpack(r[3]) for r in rows]
        keys = [np.cumsum(s[0], dtype=U64) for s in sent]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        key = np.concatenate(keys)
        count = np.concatenate([s[1] for s in sent]).astype(np.int64)
        deleted = np.where(np.repeat([r[2] == DELETED for r in rows], np.diff(at)), count, 0)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        first = np.flatnonzero(new)
        total, gone = np.add.reduceat(count[order], first), np.add.reduceat(deleted[order], first)
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        if bucket < buckets:
            ends = key[order][first] == end
            summary = [(total > 0).sum(), (total > gone).sum(), total.sum(), gone.sum(), total[ends].sum(),
                       gone[ends].sum()]
            for i, value in enumerate(summary, 1):
                yield _answer(-i, KEEP, int(value))
        for i, (_, block, kind, _) in enumerate(rows):
            mine = group[at[i]:at[i + 1]]
            arrays = [total[mine]] + ([gone[mine]] if kind == DELETED else [])
            yield _answer(block, kind, bucket, *arrays)


def _answer(block: int, kind: int, bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block]), pa.array([kind], pa.int32()), pa.array([bucket]),
                            pa.array([pack(*arrays, level=1)], pa.binary())],
                           names=["block", "kind", "bucket", "payload"])


class Estimates:
    """Counts at each token of a block, from the answers of the buckets."""

    def __init__(self, block: Block, answers: list[tuple], names: Keys, learn: bool):
        self.tokens = Tokens(block, names)
        got = dict(answers)
        self.count = []
        for n in range(1, names.order + 1):
            key, inverse = np.unique(self.tokens.keys(n), return_inverse=True)
            parts = (unpack(got[int(b)]) for b in np.unique(names.ranges(n, key)))
            values = [p[0] - p[1] if learn else p[0] for p in parts]
            self.count.append(np.concatenate([np.zeros(0, np.int64), *values])[inverse])

    def probabilities(self, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Per token: the estimates (uniform, 1 word, 2 words, ...) and the class of its longest known context."""
        t = self.tokens
        p = np.zeros((len(self.count) + 1, len(t.row)))
        p[0] = 1 / (sizes["types"] + 1)
        p[1] = self.count[0] / sizes["tokens"] if sizes["tokens"] else p[0]
        kind = np.zeros(len(t.row), np.int64)
        for n in range(1, len(self.count)):
            context = np.empty(len(t.row), np.int64)
            context[1:] = self.count[n - 1][:-1]
            context[t.begins] = sizes["texts"]  # as many beginnings as texts
            p[n + 1] = self.count[n] / np.maximum(context, 1)
            frequency = np.ceil(np.log2(context + 1)).astype(np.int64)
            kind = np.where(context > 0, 64 * n + frequency, kind)
        return p, kind


def _held(batches: Iterator[pa.RecordBatch], names: Keys, sizes: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Deleted text as counts: distinct (class, estimates) of each block and how many tokens have them."""
    for _, rows in grouped(batches):
        found = Estimates(Block(rows[-1][3]), [(r[2], r[3]) for r in rows[:-1]], names, learn=True)
        p, kind = found.probabilities(sizes)
        table, n = np.unique(np.vstack([kind.astype(float), p[1:]]), axis=1, return_counts=True)
        yield pa.record_batch([pa.array(table[0].astype(np.int64)), *map(pa.array, table[1:]), pa.array(n)],
                              names=["kind", *(f"p{i}" for i in range(1, names.order + 1)), "n"])


def learn_weights(held: DataFrame, order: int, uniform: float, steps: int = STEPS) -> dict[int, list[float]]:
    """Mixture weights per context class by expectation-maximisation over ``held`` (kind, p1.., n).

    A step is one aggregation over the held-out counts; its result has a row per class (at most 64 for each
    length of context). Estimates of contexts longer than the class allows are 0 and get no weight."""
    spark = held.sparkSession
    found = {r[0]: [1 / (2 + r[0] // 64)] * (2 + r[0] // 64) + [0.0] * (order - 1 - r[0] // 64)
             for r in held.select("kind").distinct().collect()}
    if not found:
        return {}
    names = [f"w{i}" for i in range(order + 1)]
    estimate = [F.lit(uniform)] + [F.col(f"p{i}") for i in range(1, order + 1)]
    for _ in range(steps):
        weights = spark.createDataFrame([(k, *w) for k, w in found.items()],
                                        "kind long, " + ", ".join(f"{n} double" for n in names))
        parts = [F.col(n) * e for n, e in zip(names, estimate, strict=True)]
        mixed = sum(parts[1:], parts[0])
        new = (held.join(F.broadcast(weights), "kind")
               .groupBy("kind").agg(F.sum("n").alias("n"), *[
                   F.sum(F.col("n") * part / mixed).alias(name) for part, name in zip(parts, names, strict=True)])
               .collect())
        found = {r["kind"]: [round(r[n] / r["n"], 9) for n in names] for r in new}
    return found


def _score(batches: Iterator[pa.RecordBatch], names: Keys, sizes: dict[str, int],
           weights: dict[int, list[float]]) -> Iterator[pa.RecordBatch]:
    order = names.order
    for _, rows in grouped(batches):
        kind, block = rows[-1][1], Block(rows[-1][3])
        found = Estimates(block, [(r[2], r[3]) for r in rows[:-1]], names, learn=False)
        p, classes = found.probabilities(sizes)
        table = np.zeros((int(classes.max(initial=0)) + 1, order + 1))
        for c in np.unique(classes):
            table[c] = _weights_of(int(c), weights, order)
        mixed = np.zeros(len(classes))
        for i, estimate in enumerate(p):
            mixed += table[:, i][classes] * estimate
        row, n = found.tokens.row, len(block.ids)
        base = np.log10((found.count[0] + BASE_ADD) / (sizes["tokens"] + BASE_ADD * (sizes["types"] + 1)))
        yield pa.record_batch([
            pa.array(block.ids, mask=block.null), pa.array(np.full(n, kind == HELD_OUT)),
            pa.array(found.tokens.counts, pa.int64()),
            pa.array(np.bincount(row[found.count[0] > 0], minlength=n), pa.int64()),
            pa.array(np.full(n, sizes["tokens"], np.int64)),
            pa.array(np.bincount(row, weights=base, minlength=n)),
            pa.array(np.bincount(row, weights=np.log10(mixed), minlength=n))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _weights_of(kind: int, weights: dict[int, list[float]], order: int) -> list[float]:
    """Weights of a class; one that held-out text did not show takes those of the nearest class of its length."""
    if kind in weights:
        chosen = weights[kind]
    else:
        near = [k for k in weights if k // 64 == kind // 64]
        usable = 2 + kind // 64
        chosen = weights[min(near, key=lambda k: (abs(k - kind), k))] if near else \
            [1 / usable] * usable + [0.0] * (order + 1 - usable)
    # The uniform part never vanishes, so that no token has probability 0.
    least = 1e-6
    return [(w + (least if i == 0 else 0)) / (sum(chosen) + least) for i, w in enumerate(chosen)]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                held_out_of: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Tokens are words (A-Z lower-cased) and one end per text. Rows whose crc32(doc_id as text) modulo
    ``held_out_of`` is 0 are never learned from, those with remainder 1 are the text deleted while the
    weights are learned. ``base_score``: add-0.1 unigram log10 probability; ``score``: the model's. Null
    text is empty (one token, the end). A null doc_id counts as held out. Rows that repeat are each learned
    from and scored. Without training text the score is that of the uniform distribution over no types and
    an unknown one, 0. An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    if order < 2:
        raise ValueError("order must be 2 or more")
    plain = documents(docs, id_col, text_col)
    rest = fold(F.col("doc_id"), held_out_of)
    kind = F.when(rest == 0, HELD_OUT).when(rest == 1, DELETED).otherwise(KEEP)
    blocks = to_blocks(plain, kind, "lm-blocks")
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    names = keys_for(order, size)
    parts = partitions_for(spark, size, 2 * BUCKET_BYTES)
    sent = blocks.select("block", "kind", "payload").mapInArrow(
        lambda it: _send(it, names), "bucket long, block long, kind int, payload binary")
    answers = stored(exchange(sent, parts, "bucket", "block").mapInArrow(
        lambda it: _count(it, names.buckets), "block long, kind int, bucket long, payload binary"), "lm-counts")
    sums = dict(answers.where("block < 0").groupBy("block").agg(F.sum("bucket")).collect())
    types, fit_types, tokens, gone, texts, gone_texts = (sums.get(-i, 0) for i in range(1, 7))
    all_sizes = {"types": types, "tokens": tokens, "texts": texts}
    fit_sizes = {"types": fit_types, "tokens": tokens - gone, "texts": texts - gone_texts}
    last = blocks.select("block", "kind", F.lit(1 << 62).alias("bucket"), "payload")
    real = answers.where("block > 0")
    columns = ", ".join(f"p{i} double" for i in range(1, order + 1))
    held = exchange(real.where(F.col("kind") == DELETED).union(last.where(F.col("kind") == DELETED)), parts, "block",
                    "bucket").mapInArrow(lambda it: _held(it, names, fit_sizes), f"kind long, {columns}, n long")
    weights = learn_weights(stored(held, "lm-held"), order, 1 / (fit_types + 1))
    return exchange(real.union(last), parts, "block", "bucket").mapInArrow(
        lambda it: _score(it, names, all_sizes, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
