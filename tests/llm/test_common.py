from __future__ import annotations

import os

import pytest

import corpus_pipeline
from ledgerflow.llm.common import stored, temporary
from ledgerflow.session import work_dir


def tables(spark):
    folder = work_dir(spark, "llm")
    return set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()


def test_tables_of_a_block_are_deleted_at_its_end(spark):
    before = tables(spark)
    with temporary(spark):
        outer = stored(spark.range(10), "outer")
        with temporary(spark):
            assert stored(spark.range(5), "inner").count() == 5
        assert outer.count() == 10  # the inner block deletes its own table only
        assert {n.split("-")[0] for n in tables(spark) - before} == {"outer"}
    assert tables(spark) == before
    with pytest.raises(ZeroDivisionError), temporary(spark):
        stored(spark.range(1), "failed")
        1 / 0
    assert tables(spark) == before
    kept = stored(spark.range(3), "kept")
    assert kept.count() == 3 and {n.split("-")[0] for n in tables(spark) - before} == {"kept"}


def test_a_run_of_the_pipeline_leaves_the_table_its_result_reads(spark):
    before = tables(spark)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    (left,) = tables(spark) - before
    folder = work_dir(spark, "llm", left).removeprefix("file:")
    assert left.startswith("pipeline-") and sorted(n for n in os.listdir(folder) if n.isdigit()) == ["3"]
