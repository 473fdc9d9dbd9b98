"""A corpus pipeline: five stages over documents, each a Parquet table that the next one reads.

1. language_id: documents whose language the network can't tell go (no letter, or a score below `LANG_SCORE`).
2. simhash: of each group of near copies (shingles of `SHINGLE` words, Jaccard similarity of `SIMILARITY` or more) the document
   with the smallest doc_id stays.
3. decontaminate: passages of benchmark items are cut out; documents that consist of them mostly go.
4. secrets: keys, tokens and random strings are replaced by a mark.
5. bpe: texts become token ids.

Rows keep their columns up to the last stage; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm import bpe, decontaminate, langid, secrets, simhash
from docquill.llm.common import table, written

LANG_SCORE = 0.4
SHINGLE, SIMILARITY = 5, 0.8
#: The network's labels have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid.identified(docs).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LANG_SCORE))
    return known.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(secrets.redacted(docs, secrets.trained(secrets.samples(docs))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), *bpe.vocabulary(), keep=False)
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "same")


STAGES = [("language_id", language_id), ("simhash", near_dedup), ("decontaminate", decontamination), ("secrets", secret_scan), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
