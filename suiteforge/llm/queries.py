"""The registered queries of the numbered operators (``opN_<name>``), their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import ball_codes, decontam, gru_lm, infill, langid, lz_fingerprint, neardup, pfair, prefix_tokens, quality, simhash, toxicity, warc
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of the response of every page."""
    return warc.derivatives(warc.responses_of_pages(read_table(spark, sf_dir, "pages")), keep=("page_id",))


ORACLE["op1_warc_derivatives"] = warc.derivatives_sql()


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of ten words in every whole document, by FM-index."""
    found = decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["size"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op2_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + 9], ' ') AS phrase FROM starts),
lens AS (SELECT DISTINCT l FROM win),
places AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens),
dwin AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS phrase FROM places),
hits AS (SELECT d.doc_id, d.i, d.l, win.item_id FROM dwin d JOIN win ON win.l = d.l AND win.phrase = d.phrase),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under the recurrent model and the unigram base, learnt outside fold 0 of 10."""
    found = gru_lm.score(read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return found.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: File of the public vocabulary of op4 and op7, and the token limit of op4.
VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by prefix dynamic programming, and the longest prefix within the limit."""
    counted = prefix_tokens.token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path(), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chars_within")


@query
def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text, and its likeness to its edited form and to the next document."""
    return lz_fingerprint.against_next(read_table(spark, sf_dir, "documents"))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of the sources, weights in proportion to the root of their sizes."""
    return pfair.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLE["op6_mix_sources"] = pfair.MIX_SQL


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the labelled documents outside fold 1 of 3."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, vocabulary_path(), fold("doc_id", 3) != 1)
    found = langid.predict(docs, model, vocabulary_path())
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label quality of every document: posterior of its votes, scorer's probability, and whether it stays."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumn("keep", F.col("score") >= 0.5)


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document id of its near-duplicate class and the size of that class."""
    found = neardup.classes(read_table(spark, sf_dir, "documents"))
    sizes = found.groupBy("class_node").agg(F.count(F.lit(1)).alias("class_size"))
    return found.join(sizes, "class_node").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("keep"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document, learnt from the labelled rows outside fold 0 of 5."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at lines into a fill-in-middle form, and read back from it."""
    cut = infill.transform(read_table(spark, sf_dir, "documents"), seed="7", percent=100, spm_percent=50)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"),
    )


ORACLE["op11_infill"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^
]*
|[^
]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every whole text and the smallest document id that it reaches over links of three bits."""
    found = simhash.components(read_table(spark, sf_dir, "documents"), radius=3)
    hex_digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts under codebooks of 256 entries, their errors, and the codebooks' digest."""
    codes = ball_codes.fit(read_table(spark, sf_dir, "embeddings"), keep=("label",), parts=4, entries=256, rounds=4)
    return ball_codes.with_label_errors(ball_codes.encode(codes), codes.codebooks)


ORACLE["op13_vector_codes"] = ball_codes.sql()
