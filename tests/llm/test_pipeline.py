"""Each stage of the pipeline against brute force on what the stage before it kept."""

import pytest

import corpus_pipeline as P
from axonframe.llm.common import stored

from .test_operators import check_packing, cut_by_hand, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_quality(spark, stages):
    kept = {r.doc_id for r in stages["quality_classifier"]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)


def test_near_copies(stages):
    docs = sorted(stages["quality_classifier"], key=lambda r: r.doc_id)
    sets, parent = [shingles(r.text) for r in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in stages["simhash_near_dedup"]} == {docs[i].doc_id for i in range(len(docs)) if find(i) == i}


def test_substrings(stages):
    before = stages["simhash_near_dedup"]
    _, kept = cut_by_hand([r.text for r in before], 35)
    after = {r.doc_id: r for r in stages["substring_dedup"]}
    assert len(after) == len(before)
    for r, k in zip(before, kept):
        assert (after[r.doc_id].text or "").encode().split() == k and after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_decontamination(spark, stages):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["substring_dedup"] if not any(len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in stages["benchmark_decontamination"]} == clean


def test_packing(stages):
    rows = stages["best_fit_packing"]
    n = check_packing(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages["benchmark_decontamination"]}
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_run(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, stages["best_fit_packing"]))
