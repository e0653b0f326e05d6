"""The table kept by ranges of its key: what a batch of changes reads, rewrites and leaves alone."""

from __future__ import annotations

import bisect
import glob
import uuid

import pytest

from ledgerflow.operators import changes as chg
from ledgerflow.session import work_dir
from ledgerflow.sources import versions as vs

CHANGES = "name string, seq bigint, op string, qty int"


@pytest.fixture
def stored(spark):
    path = work_dir(spark, "tests", "ranged-" + uuid.uuid4().hex)
    table = spark.createDataFrame([(f"K{i:04d}", i) for i in range(200)], "name string, qty int")
    chg.create_ranged(table, path, "name", range_rows=20)
    return path, table


def files(path):
    return {f for f in glob.glob(path.replace("file:", "") + "/_range=*/**/part-*.parquet", recursive=True)}


def rows(spark, path, table, **options):
    return sorted(tuple(r) for r in chg.read_ranged(spark, path, table.schema, **options).collect())


def test_untouched_ranges_keep_their_files(spark, stored):
    path, table = stored
    before = files(path)
    assert len({f.split("/_range=")[1].split("/")[0] for f in before}) >= 5
    first = spark.createDataFrame([("K0003", 1, "update", -1), ("K0001", 2, "delete", None), ("K0001x", 3, "create", 7)], CHANGES)
    assert chg.apply_to_ranged(spark, path, table.schema, first, "name") == 1
    after = files(path)
    assert before <= after and len({f.split("/v=")[0] for f in after - before}) <= 2
    want = {f"K{i:04d}": i for i in range(200)} | {"K0003": -1, "K0001x": 7}
    del want["K0001"]
    assert dict(rows(spark, path, table)) == want
    assert dict(rows(spark, path, table, version=0)) == {f"K{i:04d}": i for i in range(200)}
    # other ranges are not even opened: their files could be anything
    for f in before:
        if not any(f.split("/v=")[0] == g.split("/v=")[0] for g in after - before):
            with open(f, "wb") as out:
                out.write(b"not a table")
    second = spark.createDataFrame([("K0003", 9, "update", -2), ("K0000", 10, "update", 5)], CHANGES)
    assert chg.apply_to_ranged(spark, path, table.schema, second, "name") == 2
    numbers = {int(f.split("/_range=")[1].split("/")[0]) for f in files(path) if "/v=2/" in f}
    assert dict(rows(spark, path, table, ranges=sorted(numbers)))["K0003"] == -2


def test_an_emptied_range_stays_empty(spark, stored):
    path, table = stored
    gone = spark.createDataFrame([(f"K{i:04d}", i, "delete", None) for i in range(60)], CHANGES)
    chg.apply_to_ranged(spark, path, table.schema, gone, "name")
    assert rows(spark, path, table) == [(f"K{i:04d}", i) for i in range(60, 200)]
    chg.apply_to_ranged(spark, path, table.schema, gone.limit(0), "name")
    assert len(rows(spark, path, table)) == 140


def test_a_failed_batch_shows_nothing_and_runs_again(spark, stored, monkeypatch):
    path, table = stored
    batch = spark.createDataFrame([("K0003", 1, "update", -1), ("K0150", 2, "update", -1)], CHANGES)
    monkeypatch.setattr(vs, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        chg.apply_to_ranged(spark, path, table.schema, batch, "name", version=1)
    assert dict(rows(spark, path, table))["K0003"] == 3
    monkeypatch.undo()
    for _ in range(2):  # the second time it is there already
        assert chg.apply_to_ranged(spark, path, table.schema, batch, "name", version=1) == 1
        got = dict(rows(spark, path, table))
        assert (got["K0003"], got["K0150"], len(got)) == (-1, -1, 200)


def test_old_versions_are_removed(spark, stored):
    path, table = stored
    for n in range(1, 5):
        chg.apply_to_ranged(spark, path, table.schema, spark.createDataFrame([("K0003", n, "update", n)], CHANGES), "name")
    touched = next(r for r in vs.partitions(spark, path, "_range") if 4 in vs.versions(spark, path, ["_range"], [r]))
    assert vs.versions(spark, path, ["_range"], [touched]) == [3, 4]
    assert dict(rows(spark, path, table))["K0003"] == 4


def test_empty_table(spark):
    path = work_dir(spark, "tests", "ranged-" + uuid.uuid4().hex)
    table = spark.createDataFrame([], "name string, qty int")
    chg.create_ranged(table, path, "name")
    assert rows(spark, path, table) == []
    chg.apply_to_ranged(spark, path, table.schema, spark.createDataFrame([("a", 1, "create", 2)], CHANGES), "name")
    assert rows(spark, path, table) == [("a", 2)]


def test_a_row_meets_few_bounds_and_gets_the_range_of_its_key(spark, monkeypatch):
    """A row that carries all bounds is as long as the table has ranges: it meets one node of them per level."""
    met = []
    monkeypatch.setattr(chg, "slice_of", lambda key, slices=chg.GROUP_SLICES, real=chg.slice_of: met.append(slices) or real(key, slices))
    for n in (0, 1, 15, 16, 17, 300, 4095, 4096):
        cuts = [3 * i for i in range(n)]
        bounds = spark.createDataFrame([([(c,) for c in cuts],)], "_bounds array<struct<k: bigint>>")
        keys = spark.range(-2, 3 * n + 4, 1 if n < 100 else 5).selectExpr("if(id = -2, null, id) AS k")
        got = {r.k: r[chg.RANGE] for r in chg._ranged(keys, ["k"], bounds).collect()}
        assert got == {k: 0 if k is None else min(bisect.bisect_right(cuts, k), chg.GROUP_SLICES - 1) for k in got}
    assert met and max(met) <= chg.FAN


def test_a_batch_keeps_a_row_per_changed_key(spark, stored, monkeypatch):
    path, table = stored
    kept = []
    monkeypatch.setattr(chg, "materialize", lambda df, real=chg.materialize: kept.append(real(df)) or kept[-1])
    batch = spark.range(1000).selectExpr("concat('K000', id % 5) AS name", "id AS seq", "'update' AS op", "CAST(id AS int) AS qty")
    chg.apply_to_ranged(spark, path, table.schema, batch, "name")
    assert [df.count() for df in kept] == [5]
    assert dict(rows(spark, path, table))["K0004"] == 999
