"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import bestfit, extract_html, language, lines, mixing, nearcopies, negatives, neighbours, packing, quality, suffix_dedup, toxicity, variants
from evalgrid.llm.common import id_fold, read_table
from evalgrid.llm.tokens import tokenizer_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_repeat=1).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_documents(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance")


# Target shares of tokens for op6 and the pipeline: label classes of `labels`.
MIX_WEIGHTS = {"plain": 0.92, "low": 0.08, "toxic": 0.0}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: ``toxic``, else ``low`` (quality 0), else ``plain``."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
                         .when(F.col("quality") == 1, "plain").alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, label_domains(read_table(spark, sf_dir, "labels")), MIX_WEIGHTS)
    return mixed.select("doc_id", "tokens", "posterior", "rate", "copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bestfit.pack(bestfit.tokenize(read_table(spark, sf_dir, "documents"), tokenizer_path()))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.valid_rows(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


_OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.vocabulary(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_lines, op3_toxicity, op4_language, op5_quality, op6_mixing, op7_near_copies, op8_packing,
                                   op9_neighbours, op10_html, op11_bestfit, op12_negatives, op13_variants)}
ORACLE: dict[str, str] = {"op12_negatives": _OP12_SQL}
