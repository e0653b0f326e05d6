"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Two multinomials over hashed word n-grams (1 and 2 words) are counted over whole tables:
one over trusted documents, one over all documents. A document's score is the sum of the
log ratio of its n-grams, divided by their number. Documents under a threshold are
rejected, as are those that fail the base rules. The threshold is taken from the scores of
a half of the trusted documents that the counts leave out: how far text that is known to
be good falls below zero just because its words are rare depends on the size of the
corpus. Nothing depends on partitioning or order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import fold, python_tasks, stored, temporary
from ledgerflow.llm.text import U64, Words, inside, mix, ngrams, pieces, utf8

#: log2 of the number of hash buckets. The model is two counts per bucket, whatever the corpus.
BUCKET_BITS = 17
#: Added to every bucket count, as a share of the mean count of a bucket.
SMOOTHING = 1.0
#: The threshold lies so far (nats per n-gram) below the score that this share of the trusted documents
#: left out of the counts does not reach.
MARGIN, UNREACHED = 0.05, 0.001
#: Scores are ranked on a grid of this width.
GRID = 1e-4

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

SCORED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, llr double, kept boolean")


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 1- and 2-gram of a batch, and its row."""
    h = words.hashes()
    row = words.rows()
    two = inside(words.first, 2)
    keys = np.concatenate([h, ngrams(h, 2)[two] if len(h) else h])
    return (mix(keys) >> U64(64 - bits)).astype(np.int64), np.concatenate([row, row[:len(two)][two]])


def ngram_counts(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """Occurrences of the n-grams of all rows per bucket, summed per task first.

    At most 2**bits rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in pieces(batches, 0):
            bucket, _ = features(Words(*utf8(part.column(0)), lower=True), bits)
            total += np.bincount(bucket, minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(1 << bits)
    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def log_ratios(raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_trusted - log p_raw per bucket.

    Without trusted text there is nothing to compare with, and all ratios are 0."""
    if not trusted.sum():
        return np.zeros(len(raw), np.float32)

    def log_p(c: np.ndarray) -> np.ndarray:
        c = c + smoothing * c.sum() / len(c)
        return np.log(c / c.sum())

    return (log_p(trusted) - log_p(raw)).astype(np.float32)


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Words per row that lie in an ``n``-word window found twice or more in that row."""
    rows = len(words.offsets) - 1
    h = words.hashes()
    ok = inside(words.first, n)
    if not ok.any():
        return np.zeros(rows, np.int64)
    row = words.rows()
    at = np.flatnonzero(ok)
    key = mix(ngrams(h, n)[at] ^ mix(row[at].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + n, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=rows)


def duplicate_lines(text: str | None) -> int:
    """Lines (cut at newlines) that hold a word and equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _score(part: pa.RecordBatch, at: int, weights: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns n_words .. llr of the rows of a batch."""
    words = Words(*utf8(part.column(at)), lower=True)
    exact = Words(words.data, words.offsets, lower=False)
    rows = part.num_rows
    bucket, row = features(words, bits)
    n = np.bincount(row, minlength=rows)
    llr = np.bincount(row, weights=weights[bucket], minlength=rows) / np.maximum(n, 1)
    n_words = np.diff(words.first)
    repeat = repeated_words(exact, REPEAT_WINDOW)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    lines = np.array([duplicate_lines(t) for t in part.column(at).to_pylist()], np.int64)
    return [n_words, words.code_points(), words.count(_SYMBOL[words.data]), lines, repeat, failed, llr]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _threshold(left_out: DataFrame, weights, bits: int) -> float:
    """The score under which documents are rejected, from trusted texts (one column) that the counts leave out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            *_, failed, llr = _score(part, 0, weights.value, bits)
            yield pa.record_batch([pa.array(np.floor(llr[~failed] / GRID).astype(np.int64))], names=["cell"])

    # A row per grid cell: log ratios of smoothed counts lie within some tens of nats.
    cells = sorted(tuple(r) for r in left_out.mapInArrow(score, "cell long").groupBy("cell").count().collect())
    passed = int(UNREACHED * sum(n for _, n in cells))
    for cell, n in cells:
        if passed < n:
            return cell * GRID - MARGIN
        passed -= n
    return -np.inf


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  bits: int = BUCKET_BITS) -> DataFrame:
    """Every column of ``docs`` plus one struct column ``quality`` (the fields of ``SCORED``; it takes the place
    of a column of that name), one row per row.

    ``trusted_ids`` (one column, ids of trusted documents; repeats and nulls are ignored) marks the
    target text. Null text counts as empty; an empty or short text fails the base rules. Rows with a null
    id are scored and count as raw text. Rows that repeat are each scored. An empty table gives no rows.
    Without any trusted text every ratio is 0 and only the base rules decide.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    good = (trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("_good")).dropna().distinct()
            .withColumn("_counted", fold(F.col("_good"), 2) == 0))
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The trusted ids grow with the corpus, so they are never broadcast: one plan at every size. The trusted texts are
    # joined once and stored; only they are counted and scored a second time.
    with temporary(spark):
        texts = stored(plain.join(good.hint("merge"), F.col("_id") == F.col("_good")).select("_text", "_counted"),
                       "trusted", "zstd")
        weights = spark.sparkContext.broadcast(log_ratios(
            ngram_counts(plain, "_text", bits), ngram_counts(texts.where("_counted"), "_text", bits)))
        threshold = _threshold(texts.where("not _counted").select("_text"), weights, bits)
    names = [f.name for f in docs.schema.fields]
    at = names.index(text_col)
    types = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                       ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                       ("llr", pa.float64()), ("kept", pa.bool_())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            *base, failed, llr = _score(part, at, weights.value, bits)
            columns = [*base, failed, llr, ~failed & (llr >= threshold)]
            q = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)],
                                           fields=list(types))
            yield pa.record_batch([*part.columns, q], names=[*out_names, "quality"])

    # Positions, not names, carry the columns through Python, so clashing names cannot be confused.
    out_names = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    scored = docs.toDF(*out_names).mapInArrow(
        score, f"{schema}, quality struct<{SCORED.replace(' ', ':').replace(',:', ',')}>")
    return scored.select(*[F.col(c).alias(n) for c, n in zip(out_names, names, strict=True) if n != "quality"], "quality")


def kept_documents(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns (a clashing ``quality`` column stays as it is)."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    idc, textc = names.index(options.pop("id_col", "doc_id")), names.index(options.pop("text_col", "text"))
    scored = quality_rules(plain, trusted_ids, id_col=f"c{idc}", text_col=f"c{textc}", **options)
    return scored.where("quality.kept").drop("quality").toDF(*names)
