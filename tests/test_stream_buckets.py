"""What a micro-batch of the approval stream lists, reads and replaces, and that it can be run again."""

from __future__ import annotations

import datetime as dt
import glob
import uuid

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from ledgerflow import streaming as st
from ledgerflow.operators import approvals as ap
from ledgerflow.session import work_dir
from ledgerflow.sources import versions as vs
from ledgerflow.sources.fixtures import fixtures
from test_chat_stream import REQ_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def _leaves(spark):
    return spark.range(0, 40).select(
        "id", F.lit("tln_db").alias("db"), F.lit("confirm").alias("state"), F.lit("x").alias("display_name"), F.lit(1.0).alias("number_of_days"),
        F.lit(1).alias("employee_id"), F.lit("e").alias("employee_name"), F.current_date().alias("date_from"),
        F.current_date().alias("date_to"), F.lit("t").alias("holiday_status_name"))


def _req(spark, rows):
    """(request, object, action, day) as requests."""
    return spark.createDataFrame([(r, "leave", "tln_db", o, a, "u", None, None, "api", None if d is None else T0 + dt.timedelta(days=d))
                                  for r, o, a, d in rows], REQ_SCHEMA)


class Stream:
    def __init__(self, spark, buckets=8):
        self.spark, self.buckets = spark, buckets
        self.root = work_dir(spark, "tests", "buckets-" + uuid.uuid4().hex)
        self.out, self.states = f"{self.root}/out", f"{self.root}/states"

    def batch(self, batch_id, rows):
        st.approval_batch(self.spark, _req(self.spark, rows), batch_id, lambda: _leaves(self.spark), "leave", self.out, self.states,
                          buckets=self.buckets)

    def outcomes(self):
        return {r.request_id: (r.state_before, r.new_state) for r in self.spark.read.parquet(self.out).collect()}

    def state(self):
        return {int(r.object_id): r.state for r in st.current_states(self.spark, self.states).collect()}

    def files(self, what):
        return glob.glob(f"{self.root}/{what}/**/part-*.parquet".replace("file:", ""), recursive=True)


def bucket_of(spark, obj, buckets=8):
    row = spark.range(1).select(F.lit("tln_db").alias("db"), F.lit(obj).alias("object_id"))
    return row.select(st._bucket(F.lit("leave"), buckets)).first()[0]


def spoil(files):
    for f in files:
        with open(f, "wb") as out:
            out.write(b"not a table")


def test_a_batch_reads_only_its_buckets_and_days(spark):
    """Files of other buckets, of other days and of earlier outcomes are not Parquet any more: a batch does not mind."""
    s = Stream(spark)
    s.batch(0, [(f"a{o}", o, "approve", 0) for o in range(40)])
    s.batch(1, [(f"b{o}", o, "reject", 1) for o in range(40)])
    mine = bucket_of(spark, 7)
    keep = [f for f in s.files("states") if f"/bucket={mine}/" in f]
    keep += [f for f in s.files("states_seen") if f"/day=2024-01-01/part={mine % st.DAY_BUCKETS}/" in f]
    spoil([f for what in ("states", "states_seen", "out") for f in s.files(what) if f not in keep])
    s.batch(2, [("late", 7, "approve", 0), ("a7", 7, "approve", 0), ("new", 7, "reject", 5)])
    got = {r.request_id: r.state_before for r in spark.read.parquet(f"{s.out}/batch_id=2").collect()}
    assert set(got) == {"late", "new"}  # a7 is a replay of the first day; the object was refused by batch 1
    assert got["late"] == ap.DEFAULT_TRANSITIONS["leave"]["reject"]
    assert vs.versions(spark, s.states, ["bucket"], [mine]) == [1, 2]
    assert all(vs.versions(spark, s.states, ["bucket"], [b])[-1] <= 1 for b in range(8) if b != mine and vs.versions(
        spark, s.states, ["bucket"], [b]))


def test_number_of_files_does_not_grow_with_the_batches(spark):
    s = Stream(spark, buckets=2)
    for n in range(4):
        s.batch(n, [(f"r{n}-{o}", o, "approve" if n % 2 else "reject", 0) for o in range(6)])
    assert len(s.files("states")) <= 2 * 2 * 2  # two buckets, this version and the one before, some files each
    assert len(s.files("states_seen")) <= 2 * 2 * 2
    assert len(s.outcomes()) == 24 and set(s.state().values()) == {ap.DEFAULT_TRANSITIONS["leave"]["approve"]}


@pytest.mark.parametrize("upto", ["outcomes", "some states"])
def test_a_batch_that_failed_half_way_is_run_again(spark, upto):
    """The run stops after the outcomes, or after the request keys and when some buckets have their new states."""
    first, second = [(f"a{o}", o, "reject", 0) for o in range(12)], [(f"b{o}", o, "approve", 1) for o in range(12)]
    whole = Stream(spark)
    whole.batch(0, first)
    whole.batch(1, second)
    broken = Stream(spark)
    broken.batch(0, first)
    real = vs.write_version

    def failing(df, path, keys, version):
        if upto == "outcomes":
            raise OSError("lost")
        if path.endswith("_seen"):
            return real(df, path, keys, version)
        if upto == "some states":
            real(df.where("bucket < 4"), path, keys, version)
        raise OSError("lost")

    vs.write_version = failing
    try:
        with pytest.raises(OSError):
            broken.batch(1, second)
    finally:
        vs.write_version = real
    broken.batch(1, second)
    assert broken.outcomes() == whole.outcomes() and broken.state() == whole.state()


def test_requests_without_a_time_are_replays_of_one_another(spark):
    s = Stream(spark)
    s.batch(0, [("x", 1, "approve", None)])
    s.batch(1, [("x", 1, "approve", None), ("y", 1, "reject", None)])
    s.batch(2, [])
    assert set(s.outcomes()) == {"x", "y"} and s.state() == {1: ap.DEFAULT_TRANSITIONS["leave"]["reject"]}


def test_replayed_stream_in_five_chunks_equals_the_batch(spark):
    from ledgerflow.plans.stream_queries import replayed_approvals

    fx = fixtures(spark, SMOKE_DIR)
    want = ap.apply_approvals(fx["approval_request_replays"], fx["account_move"], "invoice", fx["res_partner"])
    got = replayed_approvals(fx, 5)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_a_batch_keeps_each_new_request_once(spark, monkeypatch):
    """Repeats are merged before the batch is kept, replays are dropped before the fold reads it several times."""
    kept = []
    monkeypatch.setattr(st, "materialize", lambda df, real=st.materialize: kept.append(real(df)) or kept[-1])
    s = Stream(spark)
    rows = [(f"r{i}", i, "approve", 1) for i in range(10)]
    s.batch(0, rows * 3)
    assert kept[-1].count() == 10
    s.batch(1, rows * 2 + [("new", 3, "reject", 2)])
    assert kept[-1].count() == 1
    got = spark.read.parquet(s.out)
    assert got.count() == 11 and got.where("request_id = 'new'").first().state_before == "approved"
