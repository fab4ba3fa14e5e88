"""The corpus pipeline: toxicity, near-dedup, decontamination, pseudonyms, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bpe, decontam, nearcopies, pii, toxicity
from quadloom.llm.common import drop_path, fresh, materialise, table
from quadloom.llm.queries import BPE_FILE, DEMO_KEY


#: Pre-tokens that a worker of the last stage keeps beside what the stages before it have left in its executor.
REMEMBERED = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, predicts toxic go.

    Null, empty and wordless texts score the prior and stay, unless most labels are toxic. Repeated rows go or
    stay together. An empty table gives no rows; all columns are kept, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxic_score")
    return docs.withColumn(name, toxicity.score_column(model, F.col("text"))).where(F.col(name) < model.threshold).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Null, empty and wordless texts are copies of each other; of repeated rows one stays; a row without an id
    stays only if its component has no id. An empty table gives no rows; all columns are kept.
    """
    return nearcopies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none. Repeated rows go or stay together; an empty benchmark takes nothing. All
    columns are kept, whatever their names.
    """
    name = fresh(docs, "leaks")
    return docs.withColumn(name, decontam.leaks(F.col("text"), table(spark, sf_dir, "benchmark"))).where(F.size(name) == 0).drop(name)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; n_chars, where there is one, follows the text.

    Null texts stay null (and their n_chars becomes null), empty ones empty. Every row stays, repeated ones too.
    """
    out = docs.withColumn("text", pii.pseudonymised(F.col("text"), DEMO_KEY)["text"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; one row per row. Null texts are encoded as empty ones."""
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True, remembered=REMEMBERED)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("pii", pseudonyms), ("bpe", tokens)]

#: The classifier, fingerprint components and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next, which then drops it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return docs
