"""A corpus pipeline: good, distinct, uncontaminated documents without secrets, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talewright.llm import pieces, quality, secrets, simhash, templates
from talewright.llm.common import shared_folder, table, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents among them.

    Null and empty texts get the score of an empty text; repeated rows stay or go together; all columns stay as they are.
    """
    model = quality.fit_quality(docs, quality.learnable(table(spark, sf_dir, "labels")))
    score = unused(docs, "score")
    return quality.with_quality(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles in common, or more) the document with the smallest
    id. The SimHash index is fed with the bytes of smallest shingle hashes (``simhash.similar_documents``).

    Documents without an id stay, as do all rows that share the smallest id; all columns stay as they are.
    """
    found = simhash.similar_documents(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no item of the benchmark contaminates; those without an id or a text stay, all columns stay as they are."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the secrets in their texts give way to a mark, and n_chars follows where it is a column. Null texts stay null,
    with the n_chars that they had; other columns stay as they are."""
    spans = unused(docs, "spans")
    clean = secrets.redact(secrets.scan(docs, out=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, scores, lengths, lang, source): the tokens of every document; a null text has none."""
    return pieces.encode(docs, keep=("lang", "source"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: No SQL expresses the fit of the classifier, the fingerprints and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = os.path.join(shared, f"corpus-pipeline-{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
