"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step links the neighbours of a node to their smallest neighbour. Steps are joins and
``min`` aggregates (summed per task first), and the number of steps grows with the
logarithm of the longest path. A node that holds more than one in ``HOT`` of all edges is
looked up by broadcast (there are fewer than ``HOT`` such nodes), so its edges stay where
they are; the edges of any other node are few enough to meet in one task. Steps are
written to the shared work folder, so no lineage piles up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored


#: A node with more than one in so many of all edges is looked up by broadcast.
HOT = 1_000


def _least(edges: DataFrame) -> DataFrame:
    """(p, m): the smallest v of each u."""
    return edges.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("m"))


def _look_up(edges: DataFrame, by: str, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): ``total`` edges with the m of their end ``by``, null where there is none."""
    hot = (edges.groupBy(F.col(by).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total)
           .join(least, F.col("h") == F.col("p"), "left").select("h", F.col("m").alias("hm")))
    marked = edges.join(F.broadcast(hot), F.col(by) == F.col("h"), "left")
    rest = marked.where("h is null").select("u", "v").join(least, F.col(by) == F.col("p"), "left").select("u", "v", "m")
    return marked.where("h is not null").select("u", "v", F.col("hm").alias("m")).union(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` have u > v. The smallest neighbour of v (or itself) is the smallest v that it points to."""
    return _look_up(edges, "v", _least(edges), total).select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` have u > v."""
    least = _least(edges)
    moved = _look_up(edges, "u", least, total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("p").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (two long columns) can reach.

    Repeated edges and loops do no harm; rows with a null end are ignored; an empty table gives no rows;
    extra columns cannot occur, since the first two columns are taken by position."""
    a, b = edges.columns[:2]
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(max_steps):
        total = now.count() if seen is None else seen[0]
        now = stored(_small_star(stored(_large_star(now, total), "stars"), total), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("id")).distinct()
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(tops.select("id", F.col("id").alias("component"))))
