from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from llm_helpers import words
from ledgerflow.llm import bpe, mixing, quality, secrets
from ledgerflow.llm.queries import ORACLES, QUERIES
from test_minhash import brute

DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    """Every stage on what its predecessor kept, and run() on the whole."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, last = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r["doc_id"]: r for r in docs.collect()}
        if i < 4:
            assert docs.columns == columns
        if name == "quality rules":
            labels = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").select("doc_id")
            kept = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(
                list(before.values()), out.schema), labels).where("quality.kept").collect()}
            assert set(after) == kept and 0 < len(kept) < len(before)
            assert all(after[d] == before[d] for d in after)
        elif name == "MinHash near-dedup":
            want = {d for d, _, _, keep in brute([(d, r["text"]) for d, r in before.items()], 5, 80) if keep}
            assert set(after) == want and all(after[d] == before[d] for d in after)
        elif name == "secret scans":
            assert set(after) == set(before)
            for d, r in before.items():
                spans = secrets.all_spans(r["text"])
                assert (after[d] == r) == (not spans)
                assert after[d]["n_chars"] == len(after[d]["text"])
                assert not secrets.all_spans(after[d]["text"])
        elif name.startswith("mixing"):
            assert after == before
            slot = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix_sources(
                spark.createDataFrame(list(before.values()), out.schema)).collect()}
            files = sorted((tmp_path / str(i)).glob("part-*"))
            got = [slot[r["doc_id"]] for f in files for r in spark.read.parquet(str(f)).collect()]
            assert got == sorted(slot.values())
        else:
            import public_tokenizers

            coder, _ = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
            assert set(after) == set(before)
            assert all(after[d]["n_tokens"] == len(coder.encode(before[d]["text"])) for d in before)
            last = {tuple(r) for r in after.values()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, DIR).collect()} == last


def test_stages_on_edge_rows(spark, edge, none, tmp_path):
    for table in (edge, none):
        docs = table.selectExpr("*", "'en' as lang", "length(text) as n_chars")
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DIR)
            if i < 4:
                assert out.columns == columns
                out.write.parquet(str(tmp_path / f"{table is none}{i}"))
                docs = spark.read.parquet(str(tmp_path / f"{table is none}{i}"))
            else:
                assert out.count() == docs.count()


def test_every_dealt_operator_is_registered_once():
    queries = entry.queries()
    assert "pipeline" in queries and len(corpus_pipeline.STAGES) == 5
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(QUERIES)
    assert words("a b") == ["a", "b"]


def test_rows_of_the_run_have_their_place_in_the_mixture(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DIR)
    mixed = sorted((r["slot"], r["place"], r["doc_id"]) for r in mixing.mix_sources(docs).collect())
    rows = sorted((r["position"], r["doc_id"]) for r in corpus_pipeline.run(spark, DIR).collect())
    assert rows == [(i, doc) for i, (_, _, doc) in enumerate(mixed)]


def test_place_does_not_depend_on_how_files_are_read(spark, tmp_path):
    """Files of very different sizes, read in an order that is not that of their names."""
    rows = spark.range(400, numPartitions=1).selectExpr("id as doc_id", "repeat('x', cast((id * 37) % 101 as int)) as text")
    rows.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "t"))
    got = mixing.written_order(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(got) == 400 and all(r["position"] == r["doc_id"] for r in got)
