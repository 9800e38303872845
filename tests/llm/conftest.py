"""Small tables with the awkward rows: nulls in any column, empty and long texts, ties, repeats, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

OPS = (
    "op1_warc_derivatives op2_decontaminate op3_lm_score op4_token_counts op5_lz_fingerprints op6_mix_sources op7_language "
    "op8_quality op9_near_duplicates op10_toxicity op11_infill op12_simhash"
).split()

PASSAGE = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    vocabulary = ["the", "of", "and", "river", "stone", "light", "morning", "people", "market", "window", "garden", "letter", "winter", "music"]
    return " ".join(draw.choice(vocabulary) + ("." if i % 11 == 10 else "") for i in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "   \n\t ", None, "a"),
        (4, "!!! ??? 123", "en", "b"),
        (5, "word", "en", "b"),
        (6, long, "en", "a"),
        (7, long + " tail", "en", "a"),
        (8, "x" * 50_000, "de", "a"),
        (9, prose(2, 60) + " " + PASSAGE + " " + prose(3, 60), "en", "c"),
        (10, PASSAGE, "en", "c"),
        (11, prose(4, 80), "en", "c"),
        (12, prose(4, 80), "en", "c"),
        (13, prose(4, 79) + " changed", "fr", "c"),
        (13, prose(4, 79) + " changed", "fr", "c"),
        (14, "Ünïcödé ñandú 日本語 текст \U0001f600 " + prose(5, 30), "es", "d"),
        (None, prose(6, 40), "en", "d"),
        (None, None, None, None),
        (15, "short <s> text </s> with ▁ marks", "en", "d"),
    ]
    rows += [(100 + i, prose(100 + i, 40 + i), "en", "hot") for i in range(30)]
    return rows


def write_tables(path, rows, extra: bool = True) -> str:
    ids, texts, langs, sources = ([r[i] for r in rows] for i in range(4))
    docs = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
        "source": pa.array(sources, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }
    if extra:
        for name in ("_id", "id", "node", "score", "spans", "mix_block", "_mix_key", "votes", "token", "key", "_text", "tail", "bucket"):
            docs[name] = pa.array([f"{name} {i}" for i in range(len(rows))], pa.string())
    pq.write_table(pa.table(docs), f"{path}/documents.parquet")
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "quebec romeo"), (5, PASSAGE), (None, "alpha bravo charlie")] if rows else []
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), f"{path}/benchmark.parquet")
    marked = [(i, None if i == 5 else 1, int(i % 3 == 0)) for i in ids if i is not None] + ([(11, 1, None), (None, 1, 1)] if rows else [])
    pq.write_table(pa.table({"doc_id": pa.array([m[0] for m in marked], pa.int64()), "quality": pa.array([m[1] for m in marked], pa.int32()), "toxic": pa.array([m[2] for m in marked], pa.int32())}), f"{path}/labels.parquet")
    pages = [(1, "http://a/", "<html lang='EN'><head><title> A  b </title></head><body><p>One &amp; two</p><a href=\"/x\">x</a><a href=\"/x\">y</a></body></html>"), (2, None, None), (None, "u", ""), (1, "http://a/", "plain")] if rows else []
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}), f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("edge"), edge_rows())


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [])
