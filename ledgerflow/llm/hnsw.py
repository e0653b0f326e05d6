"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's graph is
built in its task and stored as flat neighbour arrays (one per layer, -1 where a node has
fewer neighbours). Every query visits every shard of its dimension; shard results, scored
in double precision on the original vectors, are merged. Insertion and search run on many
vectors at a time: a beam of nodes per vector, expanded a few nodes at a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.blocks import exchange, pack, unpack
from ledgerflow.llm.common import partitions_for, python_tasks, stored
from ledgerflow.llm.text import U64, mix

SHARD_ROWS = 4096
#: Neighbours of a node on upper layers; layer 0 has twice as many.
LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Nodes of a beam that are expanded in one step, and vectors handled at a time.
EXPAND = 4
AT_ONCE = 256


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two so that their largest component is about 1: squares and products of very large
    or small vectors stay finite, and cosines keep every bit."""
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for large components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, enter: np.ndarray, beam: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met from ``enter`` (-1: none), for each row of ``q``: ids and products, best first."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)  # the last column takes the -1s
    seen[:, n] = True
    row = np.arange(b)[:, None]
    ids = np.full((b, beam), -1)
    near = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    new = enter
    while True:
        fresh = ~seen[row, new]
        seen[row, new] = True
        # one of several equal new ids in a row is enough
        order = np.argsort(new, axis=1, kind="stable")
        again = np.zeros_like(fresh)
        again[:, 1:] = np.take_along_axis(new, order, 1)[:, 1:] == np.take_along_axis(new, order, 1)[:, :-1]
        np.put_along_axis(fresh, order, np.take_along_axis(fresh, order, 1) & ~again, 1)
        dots = np.where(fresh, np.einsum("bkd,bd->bk", x[new], q), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids, new], axis=1)
        all_near = np.concatenate([near, dots], axis=1)
        all_open = np.concatenate([open_, fresh], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids, near, open_ = (np.take_along_axis(a, top, 1) for a in (all_ids, all_near, all_open))
        ids = np.where(np.isfinite(near), ids, -1)
        open_ &= ids >= 0
        if not open_.any():
            return ids, near
        rank = np.cumsum(open_, axis=1)
        chosen = open_ & (rank <= EXPAND)
        slot = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPAND]
        which = np.where(np.take_along_axis(chosen, slot, 1), np.take_along_axis(ids, slot, 1), -1)
        open_ &= ~chosen
        new = np.where(which[:, :, None] >= 0, links[which], -1).reshape(b, -1)


def choose(x: np.ndarray, node: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` neighbours of each node out of candidates (-1: none): near ones that are not nearer to
    one already chosen than to the node; free places are filled with the nearest others."""
    dots = np.where(ids >= 0, np.einsum("bkd,bd->bk", x[ids], x[node]), -np.inf)
    order = np.argsort(-dots, axis=1, kind="stable")
    ids, dots = np.take_along_axis(ids, order, 1), np.take_along_axis(dots, order, 1)
    ids = np.where(np.isfinite(dots) & (ids != node[:, None]), ids, -1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    between = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    taken = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        blocked = (taken[:, :j] & (between[:, j, :j] > dots[:, j:j + 1])).any(axis=1)
        taken[:, j] = (ids[:, j] >= 0) & ~blocked & (taken[:, :j].sum(axis=1) < width)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    best = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, best, 1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def add_links(x: np.ndarray, links: np.ndarray, node: np.ndarray, chosen: np.ndarray) -> None:
    """Set the neighbours of new nodes and add them to their neighbours' lists, pruned where these are full."""
    width = links.shape[1]
    links[node, :chosen.shape[1]] = chosen
    target = chosen.ravel()
    source = np.repeat(node, chosen.shape[1])
    some = target >= 0
    target, source = target[some], source[some]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    count = np.diff(np.append(first, len(target)))
    for a in range(0, len(first), AT_ONCE):
        at, n = first[a:a + AT_ONCE], count[a:a + AT_ONCE]
        new = np.full((len(at), int(n.max())), -1)
        where = np.repeat(np.arange(len(at)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        new[where, place] = source[np.repeat(at, n) + place]
        old = links[target[at]]
        # so many nodes are nearest to a few only where vectors crowd; the nearest of them are candidates
        if new.shape[1] > 2 * width:
            dots = np.where(new >= 0, np.einsum("bkd,bd->bk", x[new], x[target[at]]), -np.inf)
            new = np.take_along_axis(new, np.argsort(-dots, axis=1, kind="stable")[:, :2 * width], 1)
        links[target[at]] = choose(x, target[at], np.concatenate([old, new], axis=1), width)


class Graph:
    """Flat neighbour arrays of one shard. ``layers[0]`` holds all nodes; node ``top`` is on every layer."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], top: int):
        self.x, self.layers, self.top = x, layers, top

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        n = len(x)
        random = (mix(ids.astype(U64) ^ U64(0x632BE59BD9B4E019)) >> U64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(random + 1e-18) / np.log(links)).astype(np.int64), 8)
        top = int(np.argmax(level))
        layers = [np.full((n, links * (2 if not i else 1)), -1, np.int32) for i in range(int(level[top]) + 1)]
        order = np.argsort(mix(ids.astype(U64)), kind="stable")
        order = order[order != top]
        done, size = 0, 1
        while done < len(order):
            node = order[done:done + size]
            enter = np.full((len(node), 1), top)
            among = x[node] @ x[node].T
            among[np.triu_indices(len(node))] = -np.inf  # earlier nodes of the same portion
            for i in range(len(layers) - 1, -1, -1):
                here = level[node] >= i
                found, _ = search_layer(x, layers[i], x[node], enter, beam if here.any() else 4)
                if here.any():
                    fellow = np.where(here[None, :], among, -np.inf)
                    near = np.argsort(-fellow, axis=1, kind="stable")[:, :links]
                    fellows = np.where(np.isfinite(np.take_along_axis(fellow, near, 1)), node[near], -1)
                    cand = np.concatenate([found, fellows], axis=1)[here]
                    add_links(x, layers[i], node[here], choose(x, node[here], cand, links))
                enter = found[:, :4]
            done += size
            size = min(2 * size, AT_ONCE)
        return cls(x, layers, top)

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes near each row of ``q``, best first (-1: none). A graph no larger than the beam is read whole."""
        if len(self.x) <= beam:
            return np.argsort(-(q @ self.x.T), axis=1, kind="stable")
        found = np.full((len(q), 1), self.top)
        for links in self.layers[:0:-1]:
            found = search_layer(self.x, links, q, found, 4)[0]
        return search_layer(self.x, self.layers[0], q, found, beam)[0]


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _build(table: pa.Table) -> pa.Table:
    """One shard: equal vectors are one node, which stands for all their ids (ascending)."""
    ids, x = table.column(1).to_numpy(), _vectors(table.column(2))
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, node = np.unique((x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True,
                               return_inverse=True)
    by_node = np.argsort(node, kind="stable")
    begin = np.searchsorted(node[by_node], np.arange(len(first) + 1))
    graph = Graph.build(unit(x[first]).astype(np.float32), ids[first])
    payload = pack(np.array([x.shape[1], graph.top]), x[first].ravel(), ids[by_node], begin,
                   *(layer.ravel() for layer in graph.layers), level=1)
    return pa.table({"shard": table.column(0)[:1], "payload": pa.array([payload], pa.binary())})


class Shard:
    def __init__(self, payload: bytes):
        head, vectors, self.ids, self.begin, *layers = unpack(payload)
        dim, top = map(int, head)
        self.vectors = scaled(vectors.reshape(-1, dim))
        n = len(self.vectors)
        self.norm = np.sqrt(np.einsum("nd,nd->n", self.vectors, self.vectors))
        self.graph = Graph(unit(self.vectors).astype(np.float32), [a.reshape(n, -1) for a in layers], top)

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) rows: at least the ``k`` best found of each query, without its own id."""
        q = scaled(q)
        nodes = self.graph.search(unit(q).astype(np.float32), beam)[:, :max(beam, k + 1)]
        row, place = np.nonzero(nodes >= 0)
        node = nodes[row, place]
        length = np.sqrt(np.einsum("nd,nd->n", q, q))
        score = np.einsum("nd,nd->n", q[row], self.vectors[node]) / (length[row] * self.norm[node])
        # the smallest k + 1 ids of each node are enough, whatever the query's own id
        n = np.minimum(np.diff(self.begin)[node], k + 1)
        row, score = np.repeat(row, n), np.repeat(score, n)
        found = self.ids[np.repeat(self.begin[node], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        other = found != ids[row]
        row, score, found = row[other], score[other], found[other]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])  # repeated rows
        row, score, found = row[new], score[new], found[new]
        first = np.searchsorted(row, np.arange(len(ids)))
        best = np.arange(len(row)) - first[row] < k
        return row[best], found[best], score[best]


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shard come index first, then queries."""
    shard, at = None, None
    for batch in batches:
        part, number = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        start = 0
        while start < batch.num_rows:
            if part[start] == 0:
                shard, at = Shard(batch.column(2)[start].as_py()), number[start]
                start += 1
                continue
            end = start + 1
            while end < batch.num_rows and end - start < AT_ONCE and part[end] and number[end] == number[start]:
                end += 1
            if number[start] == at:
                ids = batch.column(3).slice(start, end - start).to_numpy()
                row, found, score = shard.nearest(ids, _vectors(batch.column(4).slice(start, end - start)), k, beam)
                yield pa.record_batch([pa.array(ids[row]), pa.array(found), pa.array(score)],
                                      names=["query_id", "vec_id", "score"])
            start = end


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    return (vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
            & F.exists(vector, lambda v: v != 0))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(index, vectors used, shards per dimension): index rows are (shard, payload), stored."""
    spark = vectors.sparkSession
    python_tasks(spark)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
    plain = plain.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    shards = max(1, -(-plain.count() // shard_rows))
    dealt = plain.select(_shard(F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard"), "vec_id", "vector")
    index = dealt.groupBy("shard").applyInArrow(_build, "shard long, payload binary")
    return stored(index, "hnsw"), plain, shards


def _shard(number: Column) -> Column:
    return F.size("vector").cast("long") * F.lit(1 << 40) + number


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``queries`` (a condition on
    ``vec_id``) holds, by cosine in double precision; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
    null id. All others do, however large or small. Only vectors of equal length are compared. Repeated rows count once; a row with the query's own id
    is no candidate. With fewer than ``k`` candidates all are returned. An empty table gives no rows; other
    columns are not read."""
    spark = vectors.sparkSession
    index, plain, shards = build_index(vectors, id_col, vector_col, shard_rows)
    asked = plain.where(queries).dropDuplicates(["vec_id"])
    # Every query visits every shard: its vector is sent to each, the index stays where it is.
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("number"), "vec_id", "vector") \
        .select(_shard(F.col("number").cast("long")).alias("shard"), F.lit(1).alias("part"),
                F.lit(None).cast("binary").alias("payload"), "vec_id", "vector")
    rows = index.select("shard", F.lit(0).alias("part"), "payload", F.lit(None).cast("long").alias("vec_id"),
                        F.lit(None).cast("array<double>").alias("vector")).union(sent)
    found = exchange(rows, partitions_for(spark, shards, 1), "shard", "part", "vec_id").mapInArrow(
        lambda it: _search(it, k, beam), "query_id long, vec_id long, score double")
    # k rows per query and shard; the window sees them already cut to k per task.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
