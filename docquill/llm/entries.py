"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquill.llm import bpe, decontaminate, langid, lmscore, packing, quality, secrets, sharding, simhash, substrings


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        langid.op1_langid, secrets.op2_secrets, bpe.op3_bpe, decontaminate.op4_decontaminate, lmscore.op5_lmscore, substrings.op6_substrings,
        quality.op7_quality, simhash.op8_simhash, packing.op9_packing, sharding.op10_sharding,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


# Words of whole texts, ten-word windows of the items (whole items of fewer words), and the words that lie in a match.
OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS k
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win
), places AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), met AS (SELECT doc_id, item, p, places.size FROM places JOIN win USING (k, size)
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM met) GROUP BY doc_id
), who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4}
