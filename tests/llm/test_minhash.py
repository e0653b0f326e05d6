from __future__ import annotations

import collections
import random

import pytest

from llm_helpers import words
from ledgerflow.llm import minhash
from ledgerflow.llm.components import components


def brute(rows, k, percent):
    """Components over exact sets; rows with one id are one node."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for i, t in rows:
        w = words(t, True)
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append((i, s))
    index = collections.defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = collections.Counter(m for x in s for m in index[x])
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                a, b = sorted((find(i), find(sets[m][0])))
                parent[b] = a
        for x in s:
            index[x].append(n)
    return sorted(((i, len(s), None if i is None else find(i) if s else i, i is None or not s or find(i) == i)
                   for i, s in sets), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("table", "k", "percent"), [("edge", 3, 85), ("small", 3, 85), ("small", 5, 80)])
def test_components_equal_exact_ones(request, table, k, percent):
    docs = request.getfixturevalue(table)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)
    assert got(minhash.near_duplicates(docs, shingle=k, percent=percent)) == want


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    """One group of near copies and a passage that many texts share, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    text = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(text)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(150, 260):
        rows.append((i, " ".join(text[:60] + [r.choice(vocabulary) for _ in range(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(minhash.near_duplicates(df, shingle=3, percent=85)) == brute(rows, 3, 85)


def test_half_keys_hold_the_miss_rate():
    for percent in (50, 80, 85, 95):
        m = minhash.half_keys(percent)
        s = (percent / 100) ** minhash.ROWS
        assert 1 - (1 - (1 - s) ** m) ** 2 <= minhash.MISS
        assert m == 1 or 1 - (1 - (1 - s) ** (m - 1)) ** 2 > minhash.MISS


def test_dropping_keeps_columns_and_one_of_each_group(edge, none):
    out = minhash.drop_near_duplicates(edge, shingle=3, percent=85)
    assert out.schema == edge.schema
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert 7 not in ids and 6 not in ids and 1 in ids and None in ids and ids.count(12) == 2
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [10_000, 12, 0])
def test_components(spark, monkeypatch, hot):
    """All, some or none of the nodes are looked up by broadcast."""
    monkeypatch.setattr("ledgerflow.llm.components.HOT", hot)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(500, 600 + i) for i in range(80)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    want = sorted((x, find(x)) for x in parent if x not in loops)
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    assert sorted(tuple(x) for x in components(df).collect()) == want
    assert components(df.limit(0)).count() == 0
