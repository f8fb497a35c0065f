"""The numbered queries and the pipeline, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, avi, checkable, fingerprints, mixing, oracles, pii, quality, secrets, toxicity, turns, warc
from .common import table, text_of
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .packing import pack


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "payload_digest", "block_digest", F.sha2("record", 256).alias("record_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(kept), 256).alias("kept_sha256"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damaged(conversations), every=conversations)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words
), shingled AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingled a JOIN shingled b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, len(any_value(s.s)) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_media_clips": op5_media_clips,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality": op11_quality,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_centroids": op13_centroids,
    "pipeline": corpus_pipeline.run,
    **checkable.QUERIES,
}
SQL: dict[str, str] = {"op4_ngram_jaccard": OP4_SQL, "op10_line_dedup": OP10_SQL, "op12_conversation_repair": oracles.OP12_SQL, "op13_centroids": oracles.OP13_SQL, **checkable.SQL}
