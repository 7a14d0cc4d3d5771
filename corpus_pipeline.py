"""The corpus pipeline: documents cleaned in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; its result is written as Parquet in the shared folder and
read again.  All stages but the last return the columns of ``documents``.

1. toxicity: rows that score 0.7 or more go (model learned from the rows of
   the stage's input that are labelled and not held out);
2. near duplicates: one row of each class of Jaccard 0.75 stays;
3. substring dedup: words of repeated windows of 35 words go, ``n_chars``
   follows the text;
4. benchmark decontamination: rows that hold a window of an item go;
5. byte-pair encoding: ids of every text that is left, and the text decoded from them.

Null texts count as empty ones and pass the stages; rows keep columns they
bring along.  There is no SQL form (stages 1 and 5); the tests hold the
pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.llm import bpe, jaccard, substring, suffixes, toxicity
from custspark.llm.common import materialize
from custspark.llm.queries import tokenizer_path
from custspark.sources.tables import Tables

ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, Tables(spark, sf_dir).labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring.deduplicate(docs, replace=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.decontaminate(docs, Tables(spark, sf_dir).benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), with_text=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table: ``(doc_id, ids, n_tokens, decoded)`` of the rows that are left."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
