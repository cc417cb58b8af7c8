"""Every operator and stage on odd and on empty tables: no crash, and the rows that its docstring promises."""

import pytest

import corpus_pipeline
from tests.llm import odd
from tracklake.llm import (compression, decontamination, licenses, packing, pii, quality, recompression, secret_scan, signature_tree, toxicity)

PER_ROW = {
    "compression": lambda s, e: compression.compression_rules(odd.frame(s, e)),
    "pii": lambda s, e: pii.personal_data(odd.frame(s, e)),
    "secrets": lambda s, e: secret_scan.secrets(odd.frame(s, e)),
    "licenses": lambda s, e: licenses.license_scan(odd.frame(s, e)),
    "toxicity": lambda s, e: toxicity.toxicity(odd.frame(s, e), odd.labels(s, e)),
    "quality": lambda s, e: quality.quality(odd.frame(s, e), odd.labels(s, e)),
}
PER_DOCUMENT = {
    "recompression": lambda s, e: recompression.dedup_substrings(odd.frame(s, e)),
    "signature_tree": lambda s, e: signature_tree.jaccard_components(odd.frame(s, e)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    got = PER_ROW[name](spark, False).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd.rows())
    assert PER_ROW[name](spark, True).count() == 0
    for r in got:
        if "score" in r.asDict():
            assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    got = PER_DOCUMENT[name](spark, False).collect()
    assert sorted(r["doc_id"] for r in got) == sorted({r[0] for r in odd.rows() if r[0] is not None})
    assert PER_DOCUMENT[name](spark, True).count() == 0


def test_scores_without_labels(spark):
    assert {r["score"] for r in toxicity.toxicity(odd.frame(spark), odd.labels(spark, True)).collect()} == {0.5}
    assert {round(r["score"], 6) for r in quality.quality(odd.frame(spark), odd.labels(spark, True)).collect()} == {0.5}


def test_copies_and_empty_sets(spark):
    got = {r["doc_id"]: r for r in PER_DOCUMENT["signature_tree"](spark, False).collect()}
    assert got[2]["component_id"] == 1 and got[2]["n_shingles"] == got[1]["n_shingles"]
    assert all(got[i]["component_id"] == i and got[i]["n_shingles"] == 0 for i in (3, 4, 5))
    assert got[6]["n_shingles"] == got[7]["n_shingles"] == 1


def test_copies_are_removed_whole(spark):
    got = {r["doc_id"]: r for r in PER_DOCUMENT["recompression"](spark, False).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == got[2]["n_words"] == 120
    assert got[10]["n_removed"] == 5_000 - 1  # every window but the first starts earlier too
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and got[3]["kept_sha256"] == got[4]["kept_sha256"]


def test_leaks_in_odd_tables(spark):
    got = decontamination.leaks(odd.frame(spark), odd.benchmark(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(12, 1)}
    for docs, bench in ((True, False), (False, True)):
        assert decontamination.leaks(odd.frame(spark, docs), odd.benchmark(spark, bench)).count() == 0
    shuffled = decontamination.leaks(odd.frame(spark), odd.benchmark(spark), broadcast_windows=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_packing_places_every_word(spark):
    got = packing.pack(packing.measured(odd.frame(spark)), capacity=512, per_source=2, shard_bins=8).collect()
    assert sum(r["n_words"] for r in got) == sum(len((r[1] or "").encode().split()) for r in odd.rows())
    assert all((r["bin_id"] is None) == (r["n_words"] == 0) for r in got)
    assert packing.pack(packing.measured(odd.frame(spark, True))).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    odd.labels(spark, empty).write.parquet(f"{tmp_path}/labels.parquet")
    odd.benchmark(spark, empty).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.frame(spark, empty)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        else:
            out.count()
