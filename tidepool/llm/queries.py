"""One registered query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation_repair, exact_dedup, html_extraction, language_id, license_scan, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, spelling_variants, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Places of the public vocabulary files; every operator takes another path as well.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SENTENCEPIECE = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts or what belongs to them, with the session set to hand texts over in small batches."""
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learnt from the rows out of the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held_out = common.id_fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs, where=~F.coalesce(held_out, F.lit(False)))
    found = language_id.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoding: doc_id, n_tokens, ids_crc32, parity with the reference library, round_trip."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.round_trip(docs, SENTENCEPIECE, keep=["doc_id"])


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the calibrated classifier."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model, keep=["doc_id"])


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts, digest of the pattern spans, all spans."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), keep=["doc_id"])


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every text: doc_id, template, start, end, matched_tokens, coverage."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; labels of the held-out fifth are not learnt."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.id_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), where=~held_out)
    return quality_classifier.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: every row with the row that stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
), g AS (
    SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
           row_number() OVER (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST) AS nth
    FROM n
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every row."""
    return simhash_dedup.near_dedup(table(spark, sf_dir, "documents"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without those in windows of 35 words that start elsewhere too."""
    left = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op11_substring_dedup"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT rid, unnest(range(len(w) - 34)) AS pos, w FROM d WHERE len(w) >= 35
), h AS (
    SELECT rid, pos, md5(array_to_string(w[pos + 1 : pos + 35], ' ')) AS win FROM s
), r AS (
    SELECT rid, pos FROM h QUALIFY count(*) OVER (PARTITION BY win) > 1
), c AS (
    SELECT rid, list(DISTINCT pos + k) AS gone FROM r, (SELECT unnest(range(35)) AS k) GROUP BY rid
), k AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i - 1)))) END AS kept
    FROM d LEFT JOIN c USING (rid)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair: counts, cost, audit and digest of every conversation."""
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversation_repair.damaged(rows), rows)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents (with planted deletions) and the frequent near word that each is a variant of."""
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), plant=spelling_variants.PLANT)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
