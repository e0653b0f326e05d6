"""Substring search by a trigram table (O-18).

Beside a table lies a table of (gram, key): every run of three characters of the lower-cased text column, once per
row, in files sorted by gram, so a gram is read by a few row groups. A row whose text matches a ``like`` pattern has
every gram of the pattern's literal parts. The search counts how often each of these grams occurs (a table of one
row per gram), intersects the rarest ones, and tests the rows left with the exact predicate. The grams of a text
that has changed may stay: they only give candidates that the predicate refuses.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import CUSTOMER_SEARCH_LIMIT
from ledgerflow.operators.lists import CUSTOMER_SEARCH_FIELDS, list_query, search_customers

GRAM = 3
#: Grams of a pattern that are intersected: the rarest ones.
RAREST = 4


def grams_of(column: Column) -> Column:
    """The distinct grams of a lower-cased text (none for shorter texts and nulls)."""
    text = F.lower(column)
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def pattern_grams(pattern: str) -> list[str]:
    """Grams that every match of a lower-case ``like`` pattern holds: those of its parts without wildcards."""
    found = {part[i:i + GRAM]: None for part in re.split("[%_]", pattern) for i in range(len(part) - GRAM + 1)}
    return list(found)


def write_grams(df: DataFrame, path: str, key: str, column: str, mode: str = "errorifexists") -> None:
    """Store the grams of ``column`` (``<path>/rows``: gram, key) and how many rows have each (``<path>/counts``).

    ``mode="append"`` adds those of new rows and of rows whose text has changed."""
    rows = df.select(F.explode(grams_of(F.col(column))).alias("gram"), F.col(key).alias("key")).where(F.col("key").isNotNull())
    # Sorted by gram and key: a very frequent gram spans many files.
    rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode(mode).parquet(f"{path}/rows")
    rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, grams: Sequence[str], rarest: int = RAREST) -> DataFrame:
    """Keys (column ``key``) of the rows that have the rarest of the grams; none if some gram does not occur."""
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(list(grams)))
    found = counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row per gram of the pattern
    rows = spark.read.parquet(f"{path}/rows")
    if len(found) < len(set(grams)):
        return rows.select("key").limit(0)
    chosen = [r["gram"] for r in sorted(found, key=lambda r: (r["n"], r["gram"]))[:rarest]]
    hits = rows.where(F.col("gram").isin(chosen))
    if len(chosen) == 1:
        return hits.select("key").distinct()
    return hits.groupBy("key").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("key")


def search_customers_indexed(customers: DataFrame, path: str, query: str, limit: int = CUSTOMER_SEARCH_LIMIT,
                             key: str = "name") -> DataFrame:
    """``search_customers`` (case-insensitive) by the trigram table at ``path``. A query without a run of three
    literal characters is answered by the scan."""
    grams = pattern_grams(query.lower())
    if not grams:
        return search_customers(customers, query, limit)
    keys = candidates(customers.sparkSession, path, grams).withColumnRenamed("key", key)
    few = customers.join(keys, key, "left_semi")
    return list_query(few, [["customer_name", "like", f"%{query}%"]], CUSTOMER_SEARCH_FIELDS, None, 0, limit)
