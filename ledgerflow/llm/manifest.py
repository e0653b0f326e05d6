"""Merkle dataset manifest by bitmap-rank indexing.

Every row is a leaf. A source's leaves form a tree in the order of their ids, three nodes to a run, and the
sources' roots form a tree in the order of their names. Where a leaf stands is found without sorting the leaves:

* tasks collect their ids as compressed bitmaps, one container per source and range of 2**12 ids; containers of
  one range are merged by OR;
* popcounts of the containers, summed along a tree of id ranges (2**12, 2**28, 2**44 ids), say how many rows of
  the source come before a container; each container has a popcount directory of its words;
* a rank query (container's base, directory, popcount of a masked word) is a leaf's coordinate.

The tree is then reduced by keyed slot arrays: a node's coordinate divided by 3**6 names its block, the remainder
its slot there, so a block of 729 slots goes through six levels at once, in one task, whatever the size of the
source. Proofs come back down the same blocks. Ids that repeat in a source are counted exactly (see ``_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks, stored
from ledgerflow.llm.text import U64
from ledgerflow.operators.sequence import rank_within_group

#: log2 of the ids of a container, of a range of containers and of a range of those.
LOW, MIDDLE, HIGH = 12, 28, 44
#: Ids of a container up to which they are kept as numbers of two bytes; beyond, as a bitmap of 512 bytes.
SPARSE = 255
#: Runs of ids and ids that a task collects before it hands its containers on.
HELD, HELD_ROWS = 20_000, 4_000_000
ARITY, LEVELS = 3, 6
BLOCK = ARITY ** LEVELS
#: Marks the node itself among its siblings in a path.
SELF = "*"


def encoded(c: Column) -> Column:
    """A value's part of a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame, fields: list[Column], doc_id: Column, source: Column, tampered: list[Column],
              changed: Column) -> DataFrame:
    """(grp, id, leaf, other): group key (null sources first), id, the leaf and that of the tampered row (else null)."""
    def digest(columns: list[Column]) -> Column:
        return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)

    # The empty key stands for a null source; all others begin with a plus sign, so bytes order them.
    grp = F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))
    return docs.select(grp.alias("grp"), doc_id.cast("long").alias("id"), digest(fields).alias("leaf"),
                       F.when(changed, digest(tampered)).alias("other"))


# --- bitmaps and coordinates ------------------------------------------------------------------------

def pack(low: np.ndarray) -> bytes:
    """A container of distinct ascending numbers below 2**12: two bytes each, or a bitmap."""
    if len(low) <= SPARSE:
        return low.astype("<u2").tobytes()
    words = np.zeros(1 << LOW >> 6, U64)
    np.bitwise_or.at(words, low >> 6, U64(1) << (low & 63).astype(U64))
    return words.tobytes()


def bitmap(container: bytes) -> np.ndarray:
    """The 64-bit words of a container."""
    if len(container) == 1 << LOW >> 3:
        return np.frombuffer(container, U64)
    low = np.frombuffer(container, "<u2").astype(np.int64)
    words = np.zeros(1 << LOW >> 6, U64)
    np.bitwise_or.at(words, low >> 6, U64(1) << (low & 63).astype(U64))
    return words


def members(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def ranks(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Set bits before each position: the directory's count of the words before, and a masked popcount."""
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    mask = (U64(1) << (low & 63).astype(U64)) - U64(1)
    return directory[low >> 6] + np.bitwise_count(words[low >> 6] & mask).astype(np.int64)


def _containers(leaves: DataFrame) -> DataFrame:
    """(grp, k0, bits, distinct, rows): a merged container per group and id range. Null ids are left out."""
    types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ["grp", "k0", "bits", "distinct", "rows"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        parts = rows = 0

        def out() -> pa.RecordBatch:
            low = {key: np.unique(np.concatenate(x)) for key, x in held.items()}
            return table([(*key, pack(x), len(x), sum(map(len, held[key]))) for key, x in low.items()])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            grps, which = code.dictionary.to_pylist(), code.indices.to_numpy()
            ids = batch.column(1).to_numpy()
            order = np.lexsort((ids >> LOW, which))
            which, ids = which[order], ids[order]
            edge = np.flatnonzero(np.diff(which, prepend=-1) | np.diff(ids >> LOW, prepend=0))
            for a, b in zip(edge, [*edge[1:], len(ids)], strict=True):
                held.setdefault((grps[which[a]], int(ids[a]) >> LOW), []).append((ids[a:b] & ((1 << LOW) - 1)).astype(np.uint16))
            parts, rows = parts + len(edge), rows + len(ids)
            if parts >= HELD or rows >= HELD_ROWS:
                yield out()
                held.clear()
                parts = rows = 0
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Containers of one key follow one another: one is held at a time."""
        key, words, rows, done = None, None, 0, []

        def end() -> None:
            low = members(words)
            done.append((*key, pack(low), len(low), rows))

        for batch in batches:
            for g, k, bits, _, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, k) == key:
                    words |= bitmap(bits)
                    rows += n
                    continue
                if key is not None:
                    end()
                key, words, rows = (g, k), bitmap(bits).copy(), n
            if done:
                yield table(done)
                done = []
        if key is not None:
            end()
            yield table(done)

    schema = "grp string, k0 long, bits binary, distinct long, rows long"
    partial = leaves.where("id is not null").select("grp", "id").mapInArrow(collect, schema)
    return partial.repartition("grp", "k0").sortWithinPartitions("grp", "k0").mapInArrow(merge, schema)


def _before(df: DataFrame, keys: list[str], order: str, n: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def _bases(containers: DataFrame, leaves: DataFrame) -> DataFrame:
    """``containers`` with ``base``, the rows of the group before it, and ``n``, all its rows.

    Counts are summed along the ranges of ids: a window holds 2**16 ranges at most (2**20 at the top)."""
    totals = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").isNull().cast("long")).alias("nulls"))
    c = containers.withColumn("k1", F.shiftright("k0", MIDDLE - LOW))
    one = c.groupBy("grp", "k1").agg(F.sum("rows").alias("r1")).withColumn("k2", F.shiftright("k1", HIGH - MIDDLE))
    two = one.groupBy("grp", "k2").agg(F.sum("r1").alias("r2"))
    two = _before(two, ["grp"], "k2", "r2", "b2").join(totals, "grp")
    one = _before(one, ["grp", "k2"], "k1", "r1", "b1").join(two, ["grp", "k2"])
    c = _before(c, ["grp", "k1"], "k0", "rows", "b0").join(one, ["grp", "k1"])
    return c.select("grp", "k0", "bits", "distinct", "rows", "n", (F.col("nulls") + F.col("b2") + F.col("b1") + F.col("b0")).alias("base"))


def _repeats(leaves: DataFrame, containers: DataFrame) -> DataFrame:
    """(grp, id, m): ids with several rows in a group, counted only where a container has more rows than bits."""
    odd = containers.where(F.col("rows") > F.col("distinct")).select("grp", "k0")
    named = leaves.where("id is not null").withColumn("k0", F.shiftright("id", LOW)).join(odd, ["grp", "k0"], "left_semi")
    return named.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")


def _ranked(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """``rows`` (grp, id, leaf, other; ids distinct in a group) with ``n`` and the coordinate ``idx``.

    A container comes before the rows of its range; it has 2**12 of them at most."""
    payload = [F.lit(None).cast("string").alias(x) for x in ("leaf", "other")]
    ids = rows.select("grp", F.shiftright("id", LOW).alias("k0"), F.lit(1).alias("kind"), F.col("id"), "leaf", "other",
                      F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<struct<low:int,more:long>>").alias("extra"),
                      F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("n"))
    tops = containers.select("grp", "k0", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), *payload, "bits",
                             "extra", "base", "n")
    both = tops.unionByName(ids).repartition("grp", "k0").sortWithinPartitions("grp", "k0", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = extra = more = None
        base = n = 0
        for batch in batches:
            row = batch.column(2).to_numpy() == 1
            low = batch.column(3).fill_null(0).to_numpy() & ((1 << LOW) - 1)
            idx, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            starts = [0, *np.flatnonzero(~row).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a < b and not row[a]:
                    words = bitmap(batch.column(6)[a].as_py())
                    twice = sorted((x["low"], x["more"]) for x in batch.column(7)[a].as_py() or ())
                    extra = np.array([x for x, _ in twice], np.int64)
                    more = np.cumsum([0, *(m for _, m in twice)], dtype=np.int64)
                    base, n = batch.column(8)[a].as_py(), batch.column(9)[a].as_py()
                    a += 1
                if a < b:
                    idx[a:b] = base + ranks(words, low[a:b]) + more[np.searchsorted(extra, low[a:b])]
                    size[a:b] = n
            keep = pa.array(row)
            yield pa.record_batch([batch.column(i).filter(keep) for i in (0, 3, 4, 5)] + [pa.array(size[row]), pa.array(idx[row])],
                                  names=["grp", "id", "leaf", "other", "n", "idx"])

    return both.mapInArrow(rank, "grp string, id long, leaf string, other string, n long, idx long")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``n``, the rows of their group, and ``idx``, their place in it (from 0), by ascending id.

    Null ids come first; rows of one id (or none) are in the order of their leaves, equal ones in any."""
    containers = stored(_bases(_containers(leaves), leaves), "manifest-containers")
    several = stored(_repeats(leaves, containers), "manifest-repeats")
    plain = leaves.where("id is not null")
    twice = not several.isEmpty()
    low = F.col("id").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int")
    if twice:
        extra = several.groupBy("grp", F.shiftright("id", LOW).alias("k0")).agg(
            F.collect_list(F.struct(low.alias("low"), (F.col("m") - 1).alias("more"))).alias("extra"))
        containers = containers.join(extra, ["grp", "k0"], "left")
        plain = plain.join(several, ["grp", "id"], "left_anti")
    else:
        containers = containers.withColumn("extra", F.lit(None).cast("array<struct<low:int,more:long>>"))
    found = _ranked(plain, containers)
    order = [F.col("leaf").asc(), F.col("_at").asc()]
    columns = ["grp", "id", "leaf", "other", "n", "idx"]
    if twice:
        none = F.lit(None).cast("string")
        first = _ranked(several.select("grp", "id", none.alias("leaf"), none.alias("other")), containers).select("grp", "id", "n", "idx")
        rows = leaves.join(several.select("grp", "id"), ["grp", "id"], "left_semi").withColumn("_at", F.monotonically_increasing_id())
        rows = rank_within_group(rows, ["grp", "id"], order, "_k").join(first, ["grp", "id"])
        found = found.unionByName(rows.withColumn("idx", F.col("idx") + F.col("_k") - 1).select(*columns))
    nameless = leaves.where("id is null")
    if not nameless.isEmpty():
        totals = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        rows = rank_within_group(nameless.withColumn("_at", F.monotonically_increasing_id()), ["grp"], order, "_k")
        found = found.unionByName(rows.join(totals, "grp").withColumn("idx", F.col("_k").cast("long") - 1).select(*columns))
    return found


# --- the tree -----------------------------------------------------------------------------------------

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


def block_levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block of a tree that has ``n`` nodes at this height: the slots first, the block's node last."""
    levels = [nodes]
    for _ in range(min(LEVELS, depth(n))):
        below = levels[-1]
        levels.append([sha("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def block_path(levels: list[list[str]], slot: int) -> list[str]:
    """Per level the run that holds the node on the way up, the node itself marked."""
    out = []
    for nodes in levels[:-1]:
        run = slot - slot % ARITY
        out.append("".join(nodes[run:slot]) + SELF + "".join(nodes[slot + 1:run + ARITY]))
        slot //= ARITY
    return out


def folded(node: str, path: list[str]) -> str:
    for run in path:
        node = sha(run.replace(SELF, node))
    return node


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, n, block, first, nodes, payload ...): a row per block, the nodes in the order of their slots."""
    slots = F.array_sort(F.collect_list(F.struct("idx", "h", *payload)))
    return (nodes.groupBy("grp", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), slots.alias("slots"))
            .select("grp", "block", "n", F.col("slots.h").alias("nodes"), *[F.col(f"slots.{p}").alias(p) for p in payload]))


def _up(blocks: DataFrame) -> DataFrame:
    """(grp, n, idx, h): the nodes of the blocks, and how many there are at their height."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [block_levels(x, n)[-1][0] for n, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            n = [-(-x // BLOCK) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(h, pa.string())],
                                  names=["grp", "n", "idx", "h"])

    return blocks.select("grp", "n", "block", "nodes").mapInArrow(reduce, "grp string, n long, idx long, h string")


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, idx, path, top): the paths of the blocks' slots, each going on by that of its block."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, n, nodes, rest, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = block_levels(nodes, n)
                paths = [block_path(levels, i) + rest for i in range(len(nodes))]
                yield pa.record_batch([pa.array([g] * len(nodes), pa.string()), pa.array(range(block * BLOCK, block * BLOCK + len(nodes)), pa.int64()),
                                       pa.array(paths, pa.list_(pa.string())), pa.array([top] * len(nodes), pa.string())],
                                      names=["grp", "idx", "path", "top"])

    joined = blocks.select("grp", "block", "n", "nodes").join(above.withColumnRenamed("idx", "block"), ["grp", "block"])
    return joined.select("grp", "block", "n", "nodes", "path", "top").mapInArrow(walk, "grp string, idx long, path array<string>, top string")


def _tree(nodes: DataFrame, payload: list[str], name: str) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Reduce every group to its root: the blocks of each height, the nodes above each height that are roots, all roots."""
    heights, roots = [], []
    level = nodes
    while True:
        blocks = stored(_blocks(level, payload if not heights else []), f"{name}-blocks")
        above = stored(_up(blocks), f"{name}-nodes")
        heights.append(blocks)
        roots.append(above.where("n = 1").select("grp", F.col("h").alias("root")))
        level = above.where("n > 1").select("grp", "n", "idx", "h")
        if level.isEmpty():
            break
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    return heights, roots, every


def _paths(heights: list[DataFrame], roots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, idx, path, top) of the blocks of the lowest height; ``tops`` (grp, path, top) has those of the roots."""
    above = None
    for blocks, done in zip(reversed(heights), reversed(roots), strict=True):
        if above is not None:
            above = _down(last, above)
        ended = done.join(tops, "grp").select("grp", F.lit(0).cast("long").alias("idx"), "path", "top")
        above = ended if above is None else above.unionByName(ended)
        last = blocks
    return above


def manifest(docs: DataFrame, fields: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source",
             tampered: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    A leaf is the hash of the ``fields`` of a row. Where ``changed`` holds, ``folded_root`` starts from the leaf
    of the row with the ``tampered`` columns in place of its own; ``verified`` says whether it is the root.
    A null source is a group of its own, the first one. Null ids come first in their source; rows of one source and
    id (which may repeat) are in the order of their leaves, and each has a leaf of its own. Nulls in ``fields`` are
    told from empty texts. An empty table has no rows. Other columns are not read.
    """
    python_tasks(docs.sparkSession)
    names = fields or [id_col, source_col, "lang", "n_chars", "text"]
    put = tampered or {}
    leaves = stored(leaf_rows(docs, [F.col(c) for c in names], F.col(id_col), F.col(source_col),
                              [put.get(c, F.col(c)) for c in names], F.coalesce(changed, F.lit(False)) if changed is not None
                              else F.lit(False)), "manifest-leaves")
    nodes = coordinates(leaves).withColumnRenamed("leaf", "h")
    heights, roots, subroots = _tree(nodes, ["id", "other"], "manifest")
    # The sources' roots are the leaves of one more tree, in the order of the sources.
    order = rank_within_group(subroots, [], [F.col("grp").asc()], "_k")
    sources = subroots.count()
    upper = stored(order.select(F.lit("").alias("grp"), F.lit(sources).cast("long").alias("n"), (F.col("_k").cast("long") - 1).alias("idx"),
                                F.col("root").alias("h"), F.col("grp").alias("of")), "manifest-sources")
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not sources:
        return docs.sparkSession.createDataFrame([], columns)
    high, high_roots, top = _tree(upper.drop("of"), [], "manifest-top")
    root = top.first()["root"]
    empty = F.array().cast("array<string>")
    way = _down(high[0], _paths(high, high_roots, top.select("grp", empty.alias("path"), F.lit("").alias("top"))))
    tops = upper.select("of", "idx", "h").join(way.select("idx", "path"), "idx").select(F.col("of").alias("grp"), "path", F.col("h").alias("top"))
    above = _paths(heights, roots, stored(tops, "manifest-tops"))
    joined = (heights[0].join(above.withColumnRenamed("idx", "block"), ["grp", "block"])
              .select("n", "nodes", "id", "other", "path", "top"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, leafs, ids, others, rest, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = block_levels(leafs, n)
                proof, end = [], []
                for slot, (leaf, other) in enumerate(zip(leafs, others, strict=True)):
                    path = block_path(levels, slot) + rest
                    proof.append(sha("".join(path).replace(SELF, "")))
                    end.append(folded(other or leaf, path))
                k = len(leafs)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(leafs), pa.array([subroot] * k), pa.array([root] * k),
                                       pa.array(proof), pa.array(end), pa.array([x == root for x in end])],
                                      names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return joined.mapInArrow(prove, columns)


def without_newlines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, Column], Column]:
    """Tampering that deletes the newlines of texts whose id, as text, has an even crc32 (a null id: none)."""
    return {text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))}, F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
