from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import toxicity
from ledgerflow.llm.text import U64, hash_words, utf8

NONE = np.zeros(0, U64)


def votes(text):
    v = toxicity.Votes(*utf8(pa.array([text])), NONE, NONE).votes[0]
    return {name for i, name in enumerate(toxicity.VOTERS) if v >> i & 1}


@pytest.mark.parametrize(("text", "fired"), [
    (None, set()), ("", set()), ("a kind word", set()),
    ("what an Idiot.", {"intellect"}), ("you are a loser", {"worth", "second_person"}),
    ("you and he said long ago that a loser", {"worth"}), ("SCUM of it", {"dirt", "exclaimed"}),
    ("a clown!", {"ridicule", "exclaimed"}), ("an 1d10t", {"disguised"}), ("just shut up now", {"phrase"}),
    ("idiot moron trash", {"intellect", "dirt", "several"}), ("imbécil", {"other_languages"}),
    ("idiotic clownfish", set()),
])
def test_voters(text, fired):
    assert votes(text) == fired


def test_votes_do_not_cross_rows():
    both = toxicity.Votes(*utf8(pa.array(["you", "idiot", "shut", "up"])), NONE, NONE).votes
    alone = [toxicity.Votes(*utf8(pa.array([t])), NONE, NONE).votes[0] for t in ("you", "idiot", "shut", "up")]
    assert both.tolist() == alone


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known probabilities, two voters copying each other, few labels."""
    r = np.random.default_rng(0)
    n = 40_000
    y = r.random(n) < 0.2
    m = len(toxicity.VOTERS)
    v = np.zeros((n, m), int)
    hit, false = [0.7, 0.6, 0.8, 0.5], [0.05, 0.1, 0.02, 0.08]
    for j in range(4):
        v[:, j] = r.random(n) < np.where(y, hit[j], false[j])
    v[:, 4] = np.where(r.random(n) < 0.9, v[:, 0], v[:, 0] ^ 1)
    label = np.where(r.random(n) < 0.05, y, -1)
    model = toxicity.LabelModel(m)
    ones = np.ones(n)
    model.fit(v, label, ones, 20)
    model.learn_tree(v, label, ones)
    model.fit(v, label, ones, 20)
    assert model.parent[4] == 0 or model.parent[0] == 4
    assert model.prior == pytest.approx(0.2, abs=0.02)
    for j in (1, 2, 3):
        if model.parent[j] < 0:
            assert model.fire[1, j, 0] == pytest.approx(hit[j], abs=0.05)
            assert model.fire[0, j, 0] == pytest.approx(false[j], abs=0.03)
    assert ((model.posterior(v) >= 0.5) == y).mean() > 0.93


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    from ledgerflow.llm.queries import op5_toxicity

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = {r["doc_id"]: r for r in op5_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [(r["toxic"], out[r["doc_id"]]["predicted"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) as toxic")
    again = toxicity.score_toxicity(docs, flipped).where("doc_id < 500").collect()
    assert all(r["score"] == pytest.approx(out[r["doc_id"]]["score"], abs=1e-6) for r in again)


def test_edge_rows(spark, edge, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (99, 1), (10, 0), (10, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    nobody = labels.limit(0)
    assert toxicity.score_toxicity(none, nobody).count() == 0
    assert toxicity.score_toxicity(edge, nobody).count() == edge.count()


def test_learned_words_come_from_all_labelled_texts(spark):
    rows = ([(f"vile word{i % 7} shared", 1) for i in range(40)] + [(f"word{i % 7} kind shared kind", 0) for i in range(300)]
            + [("Rare rare vile", 1), ("rare vile", 1), ("RARE", 1), ("", 1), (None, 0), ("twice vile", 1), ("twice", 1)])
    bad, good = collections.Counter(), collections.Counter()
    for text, label in rows:
        (bad if label else good).update(set((text or "").lower().split()))
    toxic, clean = sum(x for _, x in rows), sum(not x for _, x in rows)
    scale = toxic / clean
    ratio = {w: n / (good[w] * scale + 0.5 * max(1, scale)) for w, n in bad.items() if n >= toxicity.LEARNED_DOCUMENTS}
    texts = spark.createDataFrame(rows, "text string, label int").repartition(5)
    strong, weak = toxicity.learned_words(texts)
    hashes = lambda some: sorted(hash_words(sorted(some)).tolist())
    assert strong.tolist() == hashes(w for w, x in ratio.items() if x >= toxicity.STRONG) != []
    assert weak.tolist() == hashes(w for w, x in ratio.items() if toxicity.WEAK <= x < toxicity.STRONG) != []
    # The words in the most toxic documents are kept, and one class alone teaches nothing.
    assert [len(x) for x in toxicity.learned_words(texts, most=1)] == [1, 0]
    assert [len(x) for x in toxicity.learned_words(texts.where("label = 1"))] == [0, 0]
    assert [len(x) for x in toxicity.learned_words(texts.limit(0))] == [0, 0]
