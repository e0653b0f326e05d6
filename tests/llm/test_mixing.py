from __future__ import annotations

import random

import pytest

from ledgerflow.llm import mixing


def slots_of(runs):
    out = {}
    for r in runs:
        for block in range(r.first, r.last):
            i, a = block - r.first, len(r.slots)
            slot = r.start + i // a * r.length + r.slots[i % a]
            assert slot not in out
            out[slot] = (r.lane, block, r.phase)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_every_block_once_in_order_and_less_than_one_block_off(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    weights = [r.random() ** 3 + 0.001 for _ in range(n)] if seed % 5 else [0.0, *[1.0] * (n - 1)]
    blocks = [r.randint(0, 300) for _ in range(n)]
    runs = mixing.schedule(weights, blocks, 100)
    slots = slots_of(runs)
    assert sorted(slots) == list(range(sum(blocks)))
    done = [0] * n
    for slot in range(sum(blocks)):
        lane, block, _ = slots[slot]
        assert block == done[lane]
        done[lane] += 1
    assert done == blocks
    for phase in {x.phase for x in runs}:
        here = {x.lane: (len(x.slots) / x.length, x.start) for x in runs if x.phase == phase}
        start = next(iter(here.values()))[1]
        got, slot = dict.fromkeys(here, 0), start
        while slot in slots and slots[slot][2] == phase:
            got[slots[slot][0]] += 1
            slot += 1
            assert all(abs(got[i] - w * (slot - start)) < 1 + 1e-9 for i, (w, _) in here.items())


def test_blocks_keep_their_windows():
    parts = mixing.shares([0.5, 0.3, 0.15, 0.05], 100)
    assert parts == [50, 30, 15, 5]
    for a, slots in zip(parts, mixing.period(parts), strict=True):
        for i, slot in enumerate(slots, 1):
            assert (i - 1) * 100 // a <= slot < -(-i * 100 // a)


@pytest.mark.parametrize("weights", [None, {"src0": 0.7, "src1": 0.3, "nowhere": 1.0}])
def test_documents(spark, monkeypatch, small, weights):
    monkeypatch.setattr(mixing, "RANK_ROWS", 7)  # several ranked groups per source
    rows = mixing.mix_sources(small, weights, block_docs=3).collect()
    docs = {r["doc_id"]: r["source"] for r in small.collect()}
    assert {r["doc_id"]: r["source"] for r in rows} == docs and len(rows) == len(docs)
    places = sorted((r["slot"], r["place"]) for r in rows)
    assert len(set(places)) == len(rows)
    size = {}
    for slot, place in places:
        size[slot] = size.get(slot, 0) + 1
        assert place == size[slot] - 1
    assert sorted(size) == list(range(len(size)))
    if weights:
        named = {r["slot"] for r in rows if r["source"] in weights}
        assert max(named) < min(r["slot"] for r in rows if r["source"] not in weights)
    again = mixing.mix_sources(small.repartition(7), weights, block_docs=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_order_of_rows_and_columns(spark, small, tmp_path):
    mixed = mixing.in_mixed_order(small, block_docs=2)
    assert mixed.columns == small.columns
    slot = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix_sources(small, block_docs=2).collect()}
    got = [slot[r["doc_id"]] for r in mixed.collect()]
    assert got == sorted(slot.values())


def test_edge_rows(edge, none):
    assert mixing.mix_sources(edge).count() == edge.count()
    out = mixing.in_mixed_order(edge)
    assert out.columns == edge.columns and sorted(map(repr, out.collect())) == sorted(map(repr, edge.collect()))
    assert mixing.mix_sources(none).count() == 0 and mixing.in_mixed_order(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(edge, {"a": -1.0})


def off_target(rows, weights):
    """The largest deviation from the requested weights, in blocks, at any slot of any phase."""
    worst, phase_now = 0.0, -1
    for lane, _, phase, slot in rows:
        if phase != phase_now:
            phase_now, start, got = phase, slot, [0] * len(weights)
            here = {r[0] for r in rows if r[2] == phase} if phase else set(range(len(weights)))
            total = sum(weights[i] for i in here)
        got[lane] += 1
        worst = max(worst, *(abs(got[i] - weights[i] / total * (slot - start + 1)) for i in here))
    return worst


def test_requested_weights_hold_over_many_periods():
    """A third of 3 million documents in one source, the rest in 19 equal ones, square-root weights."""
    docs = [1_000_000, *[2_000_000 // 19] * 19]
    blocks = [-(-n // 64) for n in docs]
    weights = [n ** 0.5 for n in docs]
    rows = list(mixing.placements(weights, blocks))
    assert len(set(r[:2] for r in rows)) == len(rows) == sum(blocks) and [r[3] for r in rows] == list(range(len(rows)))
    first = [r for r in rows if r[2] == 0]
    assert len(first) > 20_000 and off_target(first, weights) < 1
    assert off_target(sorted(mixing.placements(weights, blocks, 1000), key=lambda r: r[3])[:len(first)], weights) > 1


@pytest.mark.parametrize("seed", range(20))
def test_exact_windows_in_all_phases(seed):
    r = random.Random(seed)
    weights = [r.random() ** 3 + 0.001 for _ in range(r.randint(1, 9))]
    rows = list(mixing.placements(weights, [r.randint(1, 300) for _ in weights]))
    assert [x[3] for x in rows] == list(range(len(rows)))
    worst, last = 0.0, max(x[2] for x in rows)
    left = {i: sum(x[0] == i for x in rows) for i in range(len(weights))}
    for phase in range(last + 1):
        here = [x for x in rows if x[2] == phase]
        total = sum(weights[i] for i, n in left.items() if n)
        got = dict.fromkeys([i for i, n in left.items() if n], 0)
        for t, (lane, _, _, _) in enumerate(here, 1):
            got[lane] += 1
            worst = max(worst, *(abs(got[i] - weights[i] / total * t) for i in got))
        for i, n in got.items():
            left[i] -= n
    assert worst < 1 + 1e-9


def test_shared_lane_is_dealt_out_by_weights():
    docs = [6400, 3200, 3200, *[640] * 30]
    weights, blocks = [n ** 0.5 for n in docs], [n // 64 for n in docs]
    order = list(mixing.dealt(weights, blocks))
    assert sorted(order) == sorted((s, b) for s, n in enumerate(blocks) for b in range(n))
    got = [0] * len(docs)
    until = int(min(n / w for n, w in zip(blocks, weights, strict=True)) * sum(weights))  # nobody is through before
    for t, (s, b) in enumerate(order, 1):
        assert b == got[s]
        got[s] += 1
        if t <= until:
            assert all(abs(g - w / sum(weights) * t) < 1 + 1e-9 for g, w in zip(got, weights, strict=True))


def test_sources_beyond_the_largest_keep_their_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    monkeypatch.setattr(mixing, "RANK_ROWS", 50)
    docs = spark.range(1100).selectExpr("id as doc_id", "if(id < 300, 'a', if(id < 500, 'b', concat('c', id % 4))) as source")
    rows = mixing.mix_sources(docs, block_docs=3).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 1100
    of_slot = {}
    for r in rows:
        of_slot.setdefault(r["slot"], set()).add(r["source"])
    assert sorted(of_slot) == list(range(len(of_slot))) and all(len(x) == 1 for x in of_slot.values())
    weights = {"a": 300 ** 0.5, "b": 200 ** 0.5, **{f"c{i}": 150 ** 0.5 for i in range(4)}}
    got = dict.fromkeys(weights, 0)
    for slot in range(min(r["slot"] for r in rows if r["phase"] == 1)):
        got[of_slot[slot].copy().pop()] += 1
        assert all(abs(got[s] - w / sum(weights.values()) * (slot + 1)) < 2 for s, w in weights.items())


@pytest.mark.parametrize("seed", range(6))
def test_six_hundred_sources_keep_their_stated_bounds(seed):
    """Deviation from the weights of all 600 sources, up to the first source that runs out: less than a block for the
    500 with a lane of their own, less than two for the others."""
    r = random.Random(seed)
    blocks = sorted((r.randint(30, 400) for _ in range(600)), reverse=True)
    weights = [n ** 0.5 for n in blocks]
    own = mixing.MAX_SOURCES
    inner = mixing.dealt(weights[own:], blocks[own:])
    rows = list(mixing.placements([*weights[:own], sum(weights[own:])], [*blocks[:own], sum(blocks[own:])]))
    assert len(rows) == sum(blocks)
    got, total, most, seen = [0] * 600, sum(weights), [0.0, 0.0], set()
    until = int(min(n / w for n, w in zip(blocks, weights, strict=True)) * total)  # nobody is through before
    for t, (lane, block, _, _) in enumerate(rows, 1):
        s = lane
        if lane == own:
            s, block = next(inner)
            s += own
        assert block == got[s]
        seen.add((s, block))
        got[s] += 1
        if t <= until and (t % 20 == 0 or t < 1000):
            for i, (g, w) in enumerate(zip(got, weights, strict=True)):
                most[i >= own] = max(most[i >= own], abs(g - w / total * t))
    assert len(seen) == sum(blocks) and most[0] < 1 + 1e-9 and most[1] < 2


def test_blocks_grow_with_the_corpus(spark, monkeypatch, small):
    assert mixing.block_size(0) == mixing.block_size(64 << 22) == 64
    assert mixing.block_size((64 << 22) + 1) == 65 and mixing.block_size(10**12) * mixing.MOST_BLOCKS >= 10**12
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 2)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    monkeypatch.setattr(mixing, "RANK_ROWS", 7)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    rows = mixing.mix_sources(small).collect()
    n = small.count()
    largest = max(r["count"] for r in small.groupBy("source").count().collect())
    assert len(rows) == n and max(r["place"] for r in rows) + 1 == min(-(-n // 10), largest) > 2
    slots = {r["slot"] for r in rows}
    assert slots == set(range(len(slots))) and len(slots) <= 10 + len({r["source"] for r in rows})
