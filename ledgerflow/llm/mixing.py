"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equally many documents. A source of weight w is a task
whose i-th block (from 1) is released at slot floor((i - 1) / w) and due by ceil(i / w);
earliest-deadline-first fills every slot with one released block. With weights that add up
to 1 every block meets its window, so at every slot each source has got its weight's share
to within less than one block.

When a source has no blocks left a new phase starts: the weights of the others are scaled
up to 1 and windows are counted from the phase's first slot. Windows are those of the exact
weights (kept as whole numbers) over the whole phase, so nothing adds up however long it is.
The largest sources are tasks of their own; the others share a task with the sum of their
weights, whose blocks are dealt out to them by windows in the same way: the lane is less than
a block off its share, a source of it less than a block off its part of the lane, so less than
two blocks off in all. The schedule is made block by block in one task that keeps a heap of the
sources; blocks get larger with the corpus, so that this task never places more than
``MOST_BLOCKS`` of them and one per source. Spark deals documents to blocks and joins these
with the blocks' slots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks

#: Documents of a block, at least.
BLOCK_DOCUMENTS = 64
#: Full blocks of a schedule, at most: beyond BLOCK_DOCUMENTS times as many documents the blocks are larger.
MOST_BLOCKS = 1 << 22
#: Slots of a period where rounded weights are asked for: weights are then multiples of one part in this (or in
#: ten times the sources, if more).
RESOLUTION = 1000
#: Sources with a task of their own, at most; the others share one lane.
MAX_SOURCES = 500
#: Documents that are ranked together, about: a source has a group for each so many of its documents.
RANK_ROWS = 2_000


def shares(weights: list[float], slots: int) -> list[int]:
    """Weights as whole slots of a period, at least 1 each, by largest remainder."""
    total = sum(weights)
    exact = [w / total * slots for w in weights]
    out = [max(1, int(e)) for e in exact]
    by_rest = sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))
    i = 0
    while sum(out) < slots:
        out[by_rest[i % len(out)]] += 1
        i += 1
    while sum(out) > slots:
        out[max(range(len(out)), key=lambda j: (out[j] - exact[j] if out[j] > 1 else -slots, -j))] -= 1
    return out


def period(parts: list[int]) -> list[list[int]]:
    """Slots of each task's blocks in one period of ``sum(parts)`` slots, by earliest deadline first."""
    slots = sum(parts)
    waiting = [(0, -(-slots // a), task, 1) for task, a in enumerate(parts)]  # release, deadline, task, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: list[list[int]] = [[] for _ in parts]
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, task, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, task, i))
        due, task, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out[task].append(slot)
        a = parts[task]
        if i < a:
            heapq.heappush(waiting, (i * slots // a, -(-(i + 1) * slots // a), task, i + 1))
    return out


@dataclass(frozen=True)
class Run:
    """Blocks ``first`` to ``last`` - 1 of a lane in one phase that starts at slot ``start``."""

    lane: int
    phase: int
    start: int
    first: int
    last: int
    length: int
    slots: list[int]


def schedule(weights: list[float], blocks: list[int], resolution: int = RESOLUTION) -> list[Run]:
    """The phases of all lanes (weight and number of blocks each). Lanes of weight 0 come after the others,
    in equal shares."""
    left, done = list(blocks), [0] * len(blocks)
    runs: list[Run] = []
    start = phase = 0
    while any(left):
        active = [i for i, n in enumerate(left) if n and weights[i] > 0]
        equal = not active
        active = active or [i for i, n in enumerate(left) if n]
        parts = shares([1.0 if equal else weights[i] for i in active], max(resolution, 10 * len(active)))
        length = sum(parts)
        table = period(parts)
        # The phase ends with the first lane that runs out.
        end = min((left[i] - 1) // a * length + t[(left[i] - 1) % a] + 1
                  for i, a, t in zip(active, parts, table, strict=True))
        for i, a, t in zip(active, parts, table, strict=True):
            n = end // length * a + sum(s < end % length for s in t)
            if n:
                runs.append(Run(i, phase, start, done[i], done[i] + n, length, t))
                done[i] += n
                left[i] -= n
        start += end
        phase += 1
    return runs


def placements(weights: list[float], blocks: list[int],
               resolution: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(lane, block, phase, slot) of every block, the blocks of a lane in their order. Lanes of weight 0 come after
    the others, in equal shares. With a ``resolution`` weights are rounded to whole slots of a period."""
    if resolution is not None:
        for r in schedule(weights, blocks, resolution):
            for block in range(r.first, r.last):
                i, a = block - r.first, len(r.slots)
                yield r.lane, block, r.phase, r.start + i // a * r.length + r.slots[i % a]
        return
    left, done = list(blocks), [0] * len(blocks)
    start = phase = 0
    while any(left):
        active = [i for i, n in enumerate(left) if n and weights[i] > 0]
        exact = [Fraction(weights[i]) for i in active]
        if not active:
            active = [i for i, n in enumerate(left) if n]
            exact = [Fraction(1)] * len(active)
        unit = math.lcm(*(w.denominator for w in exact))
        parts = [int(w * unit) for w in exact]
        total = sum(parts)
        waiting = [(0, -(-total // a), task, 1) for task, a in enumerate(parts)]  # release, deadline, task, block
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        slot, going = 0, True
        while going:  # the phase ends with the first lane that runs out
            while waiting and waiting[0][0] <= slot:
                _, due, task, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, task, i))
            due, task, i = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a block missed its deadline")
            lane, a = active[task], parts[task]
            yield lane, done[lane], phase, start + slot
            done[lane] += 1
            left[lane] -= 1
            slot += 1
            going = left[lane] > 0
            heapq.heappush(waiting, (i * total // a, -(-(i + 1) * total // a), task, i + 1))
        start += slot
        phase += 1


def dealt(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) in the order in which the sources of a shared lane get the lane's slots.

    Time is that of a fluid schedule, where a source of weight w has block i served from (i - 1) / w to i / w, and
    sources that are through leave their part to the others. A block may go when its service begins before the
    slot's end; of these the one that is served first goes."""
    waiting = [(0.0, s, 1) for s, n in enumerate(blocks) if n]  # begin, source, block
    leaving = sorted((blocks[s] / weights[s], s) for _, s, _ in waiting)
    heapq.heapify(waiting)
    ready: list[tuple[float, int, int]] = []
    now, gone, weight = 0.0, 0, math.fsum(weights[s] for _, s, _ in waiting)
    while waiting or ready:
        more = 1.0  # of the fluid, up to the slot's end
        while gone < len(leaving) and (leaving[gone][0] - now) * weight <= more:
            end, s = leaving[gone]
            more -= max(0.0, (end - now) * weight)
            now, gone, weight = max(now, end), gone + 1, weight - weights[s]
        if gone < len(leaving):
            now += max(0.0, more) / max(weight, weights[leaving[-1][1]])
        while waiting and (waiting[0][0] < now * (1 - 1e-12) or not ready):
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (i / weights[s], s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i - 1
        if i < blocks[s]:
            heapq.heappush(waiting, (i / weights[s], s, i + 1))


def block_size(documents: int) -> int:
    """Documents of a block, so that the schedule of all has a bounded length."""
    return max(BLOCK_DOCUMENTS, -(-documents // MOST_BLOCKS))


def tempered(counts: dict[str | None, int], power: float) -> dict[str | None, float]:
    """Target weights in proportion to a power of the source sizes (1: as they are, 0: all equal)."""
    return {s: float(n) ** power for s, n in counts.items()}


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: dict[str | None, float] | None, power: float,
            block_docs: int | None, resolution: int | None, seed: int) -> DataFrame:
    """``docs`` (columns without clashes) with _source lane, _block, _place, _phase and _slot."""
    spark = docs.sparkSession
    if weights is not None and (len(weights) > MAX_SOURCES or any(w < 0 for w in weights.values())):
        raise ValueError(f"weights must be for {MAX_SOURCES} sources at most, and not negative")
    source = F.col(source_col).cast("string")
    if weights is None:
        # The largest sources have lanes of their own, as many as a schedule may have.
        top = docs.groupBy(source.alias("s")).count().orderBy(F.desc("count"), F.asc_nulls_first("s")) \
            .limit(MAX_SOURCES).collect()
        named = [r["s"] for r in top]
        weight_of = tempered({r["s"]: r["count"] for r in top}, power)
    else:
        named = list(weights)
        weight_of = dict(weights)
    named.sort(key=lambda s: (s is not None, s))
    lane: Column = F.lit(len(named))
    if named:
        texts = [s for s in named if s is not None]
        lookup = spark.createDataFrame([(s, named.index(s)) for s in texts], "_name string, _lane int")
        docs = docs.join(F.broadcast(lookup), source == F.col("_name"), "left").drop("_name")
        known = F.when(source.isNull(), F.lit(named.index(None) if None in named else len(named))).otherwise(
            F.coalesce("_lane", F.lit(len(named))))
        docs = docs.withColumn("_lane", known.cast("int"))
    else:
        docs = docs.withColumn("_lane", lane.cast("int"))
    # Sources without a weight share the last lane, of weight 0. With tempered weights a source beyond the largest has
    # a number of its own below 0 and is a part of the last lane, which has the sum of their weights.
    others = None
    if weights is None and len(named) == MAX_SOURCES:
        number = -1 - F.xxhash64(source).bitwiseAND(F.lit((1 << 62) - 1))
        docs = docs.withColumn("_lane", F.when(F.col("_lane") < len(named), F.col("_lane").cast("long")).otherwise(number))
        others = docs.where("_lane < 0").groupBy("_lane").count()
    counts = {r["_lane"]: r["count"] for r in docs.where("_lane >= 0").groupBy("_lane").count().collect()}
    largest, shared = others.agg(F.max("count"), F.sum("count")).first() if others is not None else (None, None)
    if block_docs is None:
        block_docs = block_size(sum(counts.values()) + (shared or 0))
    sizes = [-(-counts.get(i, 0) // block_docs) for i in range(len(named) + 1)]
    table = _slots(spark, [weight_of[s] for s in named], sizes, None if largest is None else others, power, block_docs,
                   resolution)

    # Ranks inside a lane, in the order of a hash: groups by the hash's first bits, so that no lane is one group.
    groups = F.lit(1)
    if counts:
        pairs = [F.lit(x) for i, n in counts.items() for x in (i, -(-n // RANK_ROWS))]
        groups = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_lane").try_cast("int")),
                            F.lit(-(-(largest or 1) // RANK_ROWS)))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    docs = docs.withColumn("_h", h).withColumn("_g", F.floor(
        (F.col("_h").cast("double") / float(1 << 64) + 0.5) * groups).cast("long"))
    by_group = docs.groupBy("_lane", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_lane").orderBy("_g").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    # A group's rows lie in some tens of blocks (or fewer, larger ones), whose slots it brings along.
    starts = by_group.select(F.col("_lane").alias("_l2"), F.col("_g").alias("_g2"), before.alias("_before"), "_n")
    first = F.floor(F.col("_before") / block_docs)
    last = F.floor((F.col("_before") + F.col("_n") - 1) / block_docs)
    starts = starts.withColumn("_b2", F.explode(F.sequence(first, last))).join(
        table.hint("merge"), (F.col("_l2") == F.col("_l")) & (F.col("_b2") == F.col("_b")))
    starts = starts.groupBy("_l2", "_g2", "_before").agg(
        F.sort_array(F.collect_list(F.struct("_b", "_p", "_s"))).alias("_at"))
    ordered = Window.partitionBy("_lane", "_g").orderBy("_h", id_col)
    ranked = docs.withColumn("_r", F.row_number().over(ordered)).join(
        starts.hint("merge"), (F.col("_lane") == F.col("_l2")) & (F.col("_g") == F.col("_g2")))
    rank = F.col("_before") + F.col("_r") - 1
    ranked = ranked.withColumn("_block", F.floor(rank / block_docs).cast("long")) \
        .withColumn("_place", (rank % block_docs).cast("int"))
    at = F.element_at("_at", (F.col("_block") - first + 1).cast("int"))
    return ranked.withColumn("_phase", at["_p"]).withColumn("_slot", at["_s"]).drop("_at")


def _slots(spark: SparkSession, weights: list[float], sizes: list[int], others: DataFrame | None, power: float,
           block_docs: int, resolution: int | None) -> DataFrame:
    """(_l, _b, _p, _s): lane, block, phase and slot of every block, made by one task. ``sizes`` has one more lane, the
    shared one: of weight 0, or of the sum of the weights of ``others`` (_lane, count), whose blocks it holds."""
    python_tasks(spark)
    schema = pa.schema([("_l", pa.int64()), ("_b", pa.int64()), ("_p", pa.int32()), ("_s", pa.int64())])
    alone = others is None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((r["_lane"], r["count"]) for b in batches for r in b.to_pylist()) if not alone else []
        shares_ = [float(n) ** power for _, n in parts]
        blocks = [-(-n // block_docs) for _, n in parts]
        lanes = sizes if alone else [*sizes[:-1], sum(blocks)]
        inner = dealt(shares_, blocks)
        rows = placements([*weights, math.fsum(shares_)], lanes, resolution)
        while part := list(islice(rows, 1 << 14)):
            if not alone:
                for k, (lane, _, phase, slot) in enumerate(part):
                    if lane == len(weights):
                        s, block = next(inner)
                        part[k] = (parts[s][0], block, phase, slot)
            yield pa.record_batch(list(map(list, zip(*part, strict=True))), schema=schema)

    source = spark.range(0, 1, 1, 1) if alone else others.coalesce(1)
    return source.mapInArrow(make, "_l long, _b long, _p int, _s long")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id",
                source_col: str = "source", power: float = 0.5, block_docs: int | None = None,
                resolution: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, block, place, phase, slot), one row per row of ``docs``.

    ``weights``: target weight per source (None: in proportion to the ``power`` of its number of documents).
    They hold to less than one block at every slot of a phase (sources without a lane of their own: less than two),
    unless ``resolution`` asks for rounded weights. ``block_docs``: documents of a block (None: by ``block_size``).
    ``block`` is the document's block in its source, ``place`` its place in the block, ``slot`` the block's
    place in the mixture. Every document is placed once; a block that is the last of its source may be short.
    A null source is a source of its own; sources without a weight share a lane that comes last. Documents
    of a source are in the order of a hash of their id; rows that repeat an id lie next to each other, and
    null ids are ranked like any other. An empty table gives no rows; other columns are not read."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    out = _placed(plain, "doc_id", "source", weights, power, block_docs, resolution, seed)
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_place").alias("place"),
                      F.col("_phase").alias("phase"), F.col("_slot").alias("slot"))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id",
                   source_col: str = "source", power: float = 0.5, block_docs: int | None = None,
                   resolution: int | None = None, seed: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mixture: partitions (so files) by ascending slots,
    each sorted. Edge cases as in ``mix_sources``."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = _placed(plain, f"c{names.index(id_col)}", f"c{names.index(source_col)}", weights, power, block_docs,
                  resolution, seed)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (out.repartitionByRange(parts, "_slot", "_place").sortWithinPartitions("_slot", "_place")
            .select(*plain.columns).toDF(*names))


def written_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, position): rows of ``docs``, which was read from the Parquet files that ``in_mixed_order``
    was written to, with their places in that order (from 0).

    A reader packs files by their sizes, so the order of the rows read is not that of the mixture. The place is
    the row's number in its file after the rows of the files before, by the number of the task that wrote them.
    The table of files has a row per file, so as many as the writer had partitions."""
    meta = docs.metadataColumn("_metadata")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    number = [F.regexp_extract("_file", pattern, 1).try_cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = Window.orderBy(*number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = plain.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_file").alias("_file2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return plain.join(F.broadcast(files), F.col("_file") == F.col("_file2")).select(
        "doc_id", "text", (F.col("_before") + F.col("_row")).alias("position"))
