"""The operators over the tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, htmltext, langid, media, neardup, packing, pii, simhash, tokencount, toxicity
from lodestar.llm.common import id_crc, table

BYTE_BPE, PIECE_BPE, WORD_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprinted(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(langid.training_rows(docs)))
    return found.select("doc_id", F.coalesce(id_crc(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(id_crc(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(id_crc(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "worst_start", "worst_end")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_bpe, op2_fingerprints, op3_language, op4_near_duplicates, op5_toxicity, op6_html, op7_media, op8_pii, op9_token_counts, op10_packing, pipeline]
    return {f.__name__: f for f in own}


#: Shingles by joins and components by a recursive closure.
NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM worded),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared_by AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared_by JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sized USING (doc_id) JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": NEAR_DUPLICATES}
