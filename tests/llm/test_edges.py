"""Every operator and stage on awkward rows and on empty tables."""

import hashlib

import pytest

import corpus_pipeline
from suiteforge.llm import decontam, langid, lz_fingerprint, neardup, pfair, quality, toxicity
from suiteforge.llm.queries import QUERIES, vocabulary_path

from .conftest import OPS, edge_rows

N = len(edge_rows())


@pytest.fixture(scope="module")
def results(spark, edge_dir):
    return {name: QUERIES[name](spark, edge_dir).collect() for name in OPS}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_empty_pipeline(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", OPS[1:])
def test_one_row_per_document(results, name):
    assert len(results[name]) == N
    assert sorted(str(r.doc_id) for r in results[name]) == sorted(str(r[0]) for r in edge_rows())


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def test_warc_edges(results):
    rows = results["op1_warc_derivatives"]
    assert len(rows) == 8
    empty = [r for r in rows if r.page_id == 2 and r.record_type == "conversion"][0]
    assert (empty.block, empty.content_length, empty.target_uri) == ("", 0, "")
    first = [r for r in rows if r.target_uri == "http://a/" and "title: A b" in r.block][0]
    assert first.n_links == 1 and "language: en" in first.block and first.block.count("outlink: /x\r\n") == 1
    assert "One & two\nxy" in [r.block for r in rows]


def test_decontamination_edges(results):
    rows = by_id(results["op2_decontaminate"])
    assert (rows[1].n_words, rows[1].n_hit, rows[1].contaminated) == (0, 0, False)
    assert rows[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    # the null item marks words; it is not listed
    assert (rows[10].n_hit, rows[10].n_items, rows[10].items_sha256) == (12, 2, hashlib.sha256(b"1,5").hexdigest())
    assert rows[9].n_hit == 12 and not rows[6].contaminated


def test_language_edges(results):
    rows = by_id(results["op7_language"])
    assert {rows[i].lang_pred for i in (1, 2, 3, 4)} == {"und"} and rows[1].score == 0
    assert rows[11].lang_pred == rows[12].lang_pred in {"en", "fr", "es", "de"} and 0 < rows[11].score <= 1


def test_token_edges(results):
    rows = by_id(results["op4_token_counts"])
    assert (rows[1].n_bytes, rows[1].n_tokens, rows[2].n_tokens) == (0, 0, 0)
    assert rows[6].over_limit and rows[6].n_chars_within < len(edge_rows()[5][1])


def test_fingerprint_edges(results):
    rows = by_id(results["op5_lz_fingerprints"])
    assert rows[1].fingerprint == rows[2].fingerprint == "" and rows[1].n_chars == 0
    assert rows[11].fingerprint == rows[12].fingerprint and rows[12].near_next == 1.0


def test_near_duplicate_edges(results):
    rows = by_id(results["op9_near_duplicates"])
    assert rows[1].class_id == rows[2].class_id == 1 and rows[3].class_id == 3 and rows[4].class_id == 4
    assert rows[6].class_id == rows[7].class_id == 6
    assert rows[11].class_id == rows[12].class_id == rows[13].class_id == 11


def test_mix_places_every_row_once(results):
    rows = results["op6_mix_sources"]
    assert len({r.mix_position for r in rows}) == N


def test_scores_in_range(results):
    for r in results["op10_toxicity"] + results["op8_quality"] + results["op7_language"]:
        assert 0 <= r.score <= 1
    for r in results["op3_lm_score"]:
        assert r.score < 0 and r.base_score < 0 and r.n_tokens >= 1


def test_pipeline_edges(spark, edge_dir):
    rows = corpus_pipeline.run(spark, edge_dir)
    found = rows.collect()
    ids = [r.doc_id for r in found]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert all("alpha bravo charlie" not in (r.text or "").lower() for r in found)
    for stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
        assert stage[1](spark, docs, edge_dir).schema == docs.schema


def test_keep_one_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "other words stand here now"), (7, "seven"), (7, "eight"), (7, "eight")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("None", "None"), ("None", "a b c d e f"), ("None", "other words stand here now"), ("7", "seven"), ("7", "eight")])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0] and toxicity.reject(docs, model).count() == 2
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, vocabulary_path()), vocabulary_path()).collect()} == {"und"}
    assert quality.reject(docs, quality.fit(docs)).count() == 2
    assert pfair.mix(docs.withColumnRenamed("lang", "source")).count() == 2
    assert decontam.find(docs, spark.createDataFrame([], "item_id long, text string")).count() == 2
    assert lz_fingerprint.fingerprints(docs).count() == 2
