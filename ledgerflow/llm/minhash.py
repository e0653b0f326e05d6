"""MinHash near-dedup with tensored banding.

Two small collections of half keys (each of a few minhashes) are computed per document.
A table key is a pair of one half key from each, so m half keys on either side give m*m
tables from 2*m*r minhashes instead of m*m*2*r. Two sets of similarity s meet in some
table with probability (1 - (1 - s**r)**m)**2; m is chosen so that a miss at the threshold
is rarer than ``miss``.

Documents with equal sets are one class, known by its smallest id. Classes that share a
table key are joined to candidate components (a star per key, so no pairs are listed).
Inside a candidate component, classes are compared on their full sets, in blocks of
bounded size; each comparison starts with exact filters on set size and on a bitmap of
the set, and stops once two classes are known to be connected. The links found make the
final components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks, documents, partitions_for, stored
from ledgerflow.llm.components import components
from ledgerflow.llm.text import U64, Words, inside, mix, ngrams, pieces, utf8

#: Minhashes in a half key.
ROWS = 2
#: Largest accepted probability that two sets exactly at the threshold share no table.
MISS = 1e-4
#: A block of classes that are compared in one task: its number and its set elements.
BLOCK_SETS = 512
BLOCK_ELEMENTS = 1 << 20
#: 64-bit words of the bitmap of a set.
BITMAP_WORDS = 32


def half_keys(percent: int, miss: float = MISS, rows: int = ROWS) -> int:
    """Half keys per side so that sets at the threshold miss each other with probability ``miss`` at most."""
    m = 1
    while 1 - (1 - (1 - (percent / 100) ** rows) ** m) ** 2 > miss:
        m += 1
    return m


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word shingles of each row, sorted, and where each row's begin.

    A row with fewer words is one shingle of all of them; a row without words has none."""
    h, first = words.hashes(), words.first
    counts = np.diff(first)
    grams = ngrams(h, k) if len(h) else h
    ok = inside(first, k)
    total = np.zeros(len(ok) + 1, np.int64)
    np.cumsum(ok, out=total[1:])
    grams = grams[:len(ok)]
    sets = []
    for i, n in enumerate(counts):
        if n >= k:
            sets.append(np.unique(grams[first[i]:first[i] + n - k + 1]))
        elif n:
            sets.append(ngrams(h[first[i]:first[i] + n], int(n)) ^ U64(0xA0761D6478BD642F * int(n) % (1 << 64)))
        else:
            sets.append(h[:0])
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=begin[1:])
    return (np.concatenate(sets) if sets else h[:0]), begin


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)


def _signatures(docs: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """(doc_id, n, f1, f2, half): size and 128-bit fingerprint of the set, and 2*m half keys."""
    factors = _multipliers(2 * m * rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                        ("half", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            values, begin = shingle_sets(Words(*utf8(part.column(1)), lower=True), k)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            f = np.zeros((2, len(n)), U64)
            half = np.zeros((len(n), 2 * m), U64)
            if len(some):
                at = begin[some]
                f[0][some] = np.add.reduceat(mix(values ^ U64(0x9E3779B97F4A7C15)), at)
                f[1][some] = np.add.reduceat(mix(values ^ U64(0xC2B2AE3D27D4EB4F)), at)
                for i, a in enumerate(factors):
                    v = values * a
                    v ^= v >> U64(32)
                    least = np.minimum.reduceat(v, at)
                    half[some, i // rows] = mix(half[some, i // rows] * U64(0x9FB21C651E98DF25) + least)
            halves = pa.ListArray.from_arrays(np.arange(0, 2 * m * len(n) + 1, 2 * m, dtype=np.int32),
                                              pa.array(half.view(np.int64).ravel()))
            yield pa.record_batch([part.column(0), pa.array(n), pa.array(f[0].view(np.int64)),
                                   pa.array(f[1].view(np.int64)), halves], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, half array<long>")


def _candidate_edges(classes: DataFrame, m: int) -> DataFrame:
    """(id, least): each class with the smallest class that shares one of its m*m table keys."""
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda t: F.xxhash64(
        t, F.element_at("half", (t / m).cast("int") + 1), F.element_at("half", F.lit(m + 1) + t % m))))
    keys = classes.select("id", pairs.alias("key"))
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return keys.join(least.select("key", "least"), "key").where("id > least").select("id", "least").distinct()


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit per element (by its hash): sets that differ in d elements have bitmaps that differ in d bits at most."""
    out = np.zeros((len(sets), BITMAP_WORDS), U64)
    for i, s in enumerate(sets):
        bit = mix(s ^ U64(0x27D4EB2F165667C5)) >> U64(64 - (BITMAP_WORDS * 64).bit_length() + 1)
        np.bitwise_or.at(out[i], (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


def connect(ids: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets whose similarity is ``percent`` or more (each found link is a true one).

    ``side``: 0 or 1 per set. Where both occur, only pairs from different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    maps = _bitmaps(sets)
    root = np.arange(len(ids))
    both = side.any() and not side.all()
    links = []

    for x in range(1, len(ids)):
        small, large = np.minimum(sizes[:x], sizes[x]), np.maximum(sizes[:x], sizes[x])
        may = (100 * small >= percent * large) & (root[:x] != root[x])
        if both:
            may &= side[:x] != side[x]
        near = np.flatnonzero(may)
        if not len(near):
            continue
        apart = np.bitwise_count(maps[near] ^ maps[x]).sum(axis=1, dtype=np.int64)
        # similarity p means |a xor b| * (100 + p) <= (100 - p) * (|a| + |b|), and bits differ in no more places
        near = near[apart * (100 + percent) <= (100 - percent) * (sizes[near] + sizes[x])]
        for y in near:
            if root[y] == root[x]:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                links.append((ids[x], ids[y]))
                a, b = sorted((root[x], root[y]))
                root[root == b] = a
    return links


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links inside the candidate components ``members`` (id, comp, n, f1, f2)."""
    spark = docs.sparkSession
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    sizes = sizes.select("comp", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(
        F.col("elements") / BLOCK_ELEMENTS)).cast("long").alias("blocks"))
    total = members.agg(F.sum("n")).first()[0] or 0
    placed = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    # A class takes part in every pair of blocks that its block is in; one block is a pair with itself.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The members grow with the corpus, so they are never broadcast: one plan at every size.
    texts = docs.join(members.select("id", F.col("f1").alias("g1")).hint("merge"),
                      F.col("doc_id") == F.col("id")).select("id", "text", "g1")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            values, begin = shingle_sets(Words(*utf8(part.column(1)), lower=True), k)
            rows = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            f = [int(mix(values[a:b] ^ U64(0x9E3779B97F4A7C15)).sum().view(np.int64))
                 for a, b in zip(begin[:-1], begin[1:], strict=True)]
            mine = np.array(f, np.int64) == part.column(2).to_numpy()  # one id may name rows of several classes
            yield pa.record_batch([part.column(0), pa.array(rows, pa.binary())], names=["id", "elements"]).filter(
                pa.array(mine))

    sets = texts.mapInArrow(to_sets, "id long, elements binary").dropDuplicates(["id", "elements"])
    first, second = F.least("block", "other"), F.greatest("block", "other")
    work = (placed.select("id", "comp", first.alias("i"), second.alias("j"),
                          (F.col("block") != F.col("other")).cast("int").alias("two"),
                          (F.col("block") > F.col("other")).cast("int").alias("side"))
            .join(sets, "id"))
    parts = partitions_for(spark, total, 4 * BLOCK_ELEMENTS)
    work = (work.select("comp", "i", "j", "side", "id", "elements").repartition(parts, "comp", "i", "j")
            .sortWithinPartitions("comp", "i", "j", "side", "id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sides, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            links = connect(ids, sets, np.array(sides), percent)
            return pa.record_batch([pa.array([a for a, _ in links], pa.int64()),
                                    pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for comp, i, j, side, id_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j) != group:
                    if len(ids) > 1:
                        yield done()
                    group, ids, sides, sets = (comp, i, j), [], [], []
                ids.append(id_)
                sides.append(side)
                sets.append(np.frombuffer(data, U64))
        if len(ids) > 1:
            yield done()

    return work.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are lower-cased in A-Z. Documents whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``percent`` per cent or more are linked; ``component_id`` is the smallest doc_id
    reachable over links, and ``kept`` says that it is the document's own. Documents with null or empty
    text, or no words, have no shingles and are linked with nothing. A null doc_id takes no part: its
    component is null and it is kept. Rows with one doc_id are one document: its links are those of all
    its texts. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    plain = documents(docs, id_col, text_col)
    m = half_keys(percent, miss)
    signatures = stored(_signatures(plain, shingle, m, ROWS), "signatures")
    real = signatures.where("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("half").alias("half")),
                     "classes")
    candidates = components(_candidate_edges(classes, m))
    members = stored(classes.select("id", "n", "f1", "f2")
                     .join(candidates.withColumnRenamed("component", "comp"), "id"), "members")
    links = _links(plain, members, shingle, percent)
    # Rows that share an id connect the classes they are in.
    shared = real.groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x < y")
    same = (real.join(shared.select("doc_id"), "doc_id").join(classes.select("f1", "f2", "id"), ["f1", "f2"])
            .select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    found = components(links.union(same))
    named = (classes.join(found, "id", "left")
             .select("f1", "f2", F.coalesce("component", "id").alias("component_id")))
    out = signatures.join(named, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not kept (same columns). Rows with a null id stay; of rows
    that repeat a kept id all stay."""
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(id_col)}"
    return plain.join(gone, F.col(at).cast("long") == F.col("_gone"), "left_anti").toDF(*names)
