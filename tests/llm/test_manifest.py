from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow.llm import manifest as mf

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def runs(nodes):
    return [nodes[i:i + 3] for i in range(0, len(nodes), 3)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*r) for r in runs(levels[-1])])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = runs(nodes)[i // 3]
        out.append((run[:i % 3], run[i % 3 + 1:]))
        i //= 3
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by sorting, one level after another."""
    groups = {}
    for r in rows:
        doc_id, source, _, _, text = r
        leaf = h(*map(enc, r))
        odd = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = h(*map(enc, (*r[:4], text.replace("\n", "") if text is not None else None))) if odd else leaf
        groups.setdefault(source, []).append((doc_id, leaf, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, other) in enumerate(groups[s]):
            way = siblings(trees[s], i) + siblings(top, k)
            node = other
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in way for x in (*left, *right)])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(df):
    tampered, changed = mf.without_newlines(df)
    got = mf.manifest(df, tampered=tampered, changed=changed)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


ROWS = [(i, "a", "en", 3, f"x\n{i}") for i in range(1, 23)]
ROWS += [(7, "a", "en", 3, "x\n7")] * 3 + [(7, "a", "de", None, "another")] * 2  # one id: equal and other rows
ROWS += [(None, "a", None, None, "no id"), (None, "a", None, None, None), (None, None, None, None, "no id or source")]
ROWS += [(i, None, "en", 1, None) for i in (-5, 2**62, -2**62, 0, 4095, 4096, 1 << 28, (1 << 44) + 3)]
ROWS += [(1, "", "en", 0, ""), (1, "é", "en", 2, "\n\n"), (9, "z", None, 5, "-"), (2, "é", "en", 2, "été\n中文 \U0001f600")]
ROWS += [(50, "long", "en", 9, "word \n" * 200_000)]


def test_edge_rows_against_brute_force(spark):
    """Null, empty, repeated, negative and far ids; null and empty sources; a lone leaf; clashing columns."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = brute(ROWS)
    for name in ("grp", "id", "leaf", "idx", "n", "block", "root", "h"):
        df = df.withColumn(name, df.lang)
    assert run(df.repartition(5)) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


def test_more_than_one_block_and_height(spark, monkeypatch):
    """Sources of 1 to 2,000 rows: one and two heights of blocks, sparse ids."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("one", 1), ("block", 729), ("more", 730), ("two", 2_000)):
        ids = rng.choice(1 << 20, n, replace=False).tolist()
        rows += [(i, s, "en", i % 7, "a\nb" if i % 3 else "c") for i in ids]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_sources_beyond_a_block(spark):
    rows = [(i, f"s{i % 800}", "en", 1, f"t\n{i}") for i in range(1_000)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert run(df.limit(0)) == []
    assert run(df) == brute(ROWS[:1])


def test_no_row_is_changed_without_tampering(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = mf.manifest(df).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_coordinates_of_a_hot_id(spark):
    """One id holds a third of all rows: places are those of the sorted rows, without gaps."""
    df = spark.range(0, 3_000, 1, 6).select(F.lit("g").alias("grp"), F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("id"),
                                            F.lit("same").alias("leaf"), F.lit(None).cast("string").alias("other"))
    rows = mf.coordinates(df).collect()
    assert sorted(r["idx"] for r in rows) == list(range(3_000))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["idx"])] == sorted(r["id"] for r in rows)
    assert {r["n"] for r in rows} == {3_000}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 4095), max_size=600))
def test_containers(ids):
    low = np.array(sorted(ids), np.int64)
    words = mf.bitmap(mf.pack(low))
    assert mf.members(words).tolist() == low.tolist()
    assert len(mf.pack(low)) <= 512
    at = np.arange(4096)
    assert mf.ranks(words, at).tolist() == np.searchsorted(low, at).tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_paths_fold_to_the_node_of_the_block(n):
    levels = mf.block_levels([h(str(i)) for i in range(n)], n)
    assert levels == tree(levels[0])
    for i in range(n):
        assert mf.folded(levels[0][i], mf.block_path(levels, i)) == levels[-1][0]
