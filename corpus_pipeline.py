"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and its rows are written and reread for the next.

Quality classifier (rejected documents go), near-duplicates (of each component the smallest doc_id stays), secret scan (spans are
replaced), mix of sources (whole documents, repeated or left out as their source's target asks) and SentencePiece encoding. All but the last
return the columns of documents. Each stage states in its operator what NULLs, empty texts, ties and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import common, mixing, overlap, pieces, quality, secret_scan, simhash
from gapweave.plans.storage import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is 0.5 or more."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    weights = quality.train(common.table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return quality.assess(docs, weights, F.col("source"), F.col("lang")).where("good").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: that of the smallest doc_id; of rows that share it, one.

    Documents whose SimHash fingerprints differ in three bits or fewer (operator 2) are near-duplicates. So are those that share four fifths
    or more of their five-word shingles: fingerprints are too narrow to find most of these, and a component follows links of both kinds.
    Documents without an id name no component: of a component in which no document has an id, one row stays.
    """
    return overlap.one_of_each(docs, lambda rows: simhash.near_duplicates(rows).select("row", F.col("root").alias("group")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, spans of secrets replaced and ``n_chars`` counted anew where a text changed."""
    found = secret_scan.scan(docs)
    text = secret_scan.redact(found)
    n = F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    return mixing.whole_documents(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document with their digests."""
    return pieces.encode_decode(docs, pieces.default_model())


STAGES = [("quality", keep_good), ("simhash", keep_one_of_each_group), ("secrets", redact_secrets), ("mix", mix_sources), ("sentencepiece", encode)]
ORACLE_SQL = None  # a trained classifier and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
