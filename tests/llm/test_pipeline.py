"""The corpus pipeline, stage by stage, against what each stage says of itself."""

import random
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from loomspan.llm import jaccard, pii, queries

from .test_queries import brute_ids, check_packing, crc


def test_stages(spark, folder, docs):
    columns = list(docs[0])
    held = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        held = stage(spark, held, folder)
        held.write.mode("overwrite").parquet(f"{folder}/stage-{name}.parquet")
        held = spark.read.parquet(f"{folder}/stage-{name}.parquet")
        if name != "packing":
            assert held.columns == columns
        seen[name] = [r.asDict() for r in held.collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    kept = Counter(map(key, seen["language"]))
    assert not kept - Counter(map(key, docs))
    gone = [r for r in docs if key(r) not in kept]
    assert {r["doc_id"] for r in gone} >= {13, 14, 15} and len(gone) <= 8
    few = seen["near-duplicates"]
    assert not Counter(map(key, few)) - kept
    assert sum(r["doc_id"] in (4, 10) for r in few) == 1
    want = Counter(r for r in ((x["doc_id"], x["text"]) for x in few))
    assert max(want.values()) == 1
    masked = {r["doc_id"]: r["text"] for r in seen["personal data"]}
    assert len(seen["personal data"]) == len(few)
    assert all(not pii.base_spans(t) for t in masked.values()) and "<EMAIL>" in masked[16]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal data"])
    times = Counter((r["doc_id"], r["text"]) for r in seen["mixture"])
    assert max(times.values()) <= 2 and set(times) <= set((r["doc_id"], r["text"]) for r in seen["personal data"])
    pieces = Counter()
    for doc, ids in brute_ids("word_bpe_49k.json", seen["mixture"]):
        for k in range(0, len(ids), 2048):
            pieces[doc, k // 2048, crc(ids[k : k + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen["packing"]) == pieces
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in seen["packing"]], 2048, 1)


def test_run(spark, nothing):
    assert cp.run(spark, nothing).count() == 0
    assert queries.vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_nothing(spark, nothing, name, stage):
    assert stage(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).count() == 0


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_near_copies_go(spark, monkeypatch, sent):
    """Planted pairs of 5-word Jaccard 0.8 to 0.95 lose one document, pairs under 0.8 none."""
    monkeypatch.setattr(jaccard, "SENT", sent)
    rng, rows, want = random.Random(4), [], {}
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i in range(120):
        own = [word() for _ in range(rng.randint(60, 300))]
        near = list(own)
        for _ in range(rng.randint(1, 1 + len(own) // 40)):
            near[rng.randrange(len(near))] = word()
        a, b = grams(own), grams(near)
        want[2 * i + 1] = len(a & b) * 10 < len(a | b) * 8
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near).upper())]
    assert 30 < sum(want.values()) < 90
    kept = {r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0 or want[d]}


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Where no MinHash bucket is shared, SimHash still brings near copies together; the exact check follows it."""
    monkeypatch.setattr(jaccard, "band_keys", lambda sets: np.arange(len(sets) * jaccard.BANDS).reshape(-1, jaccard.BANDS) + np.array([[int(s[0] >> np.uint64(20))] for s in sets]))
    rng, rows = random.Random(6), []
    for i in range(20):
        own = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2500)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(["new", *own]))]
    rows += [(100, ""), (101, None), (102, "a b c"), (103, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()}
    assert {*range(0, 40, 2), 100, 102, 103} <= kept and len(kept & set(range(1, 40, 2))) <= 4
