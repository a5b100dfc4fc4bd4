"""A corpus pipeline from stages of ``tidemark.llm``; each stage's rows are written as Parquet and read by the next.

Every stage but the last returns the columns of its input. The input needs doc_id, text, lang and source; other columns
are carried along, and an ``n_chars`` column follows the text. Empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base, langid, linededup, mixing, packing, simhash

#: SQL cannot express language identification, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is undecided: no letter, or no language ahead of the others.

    The model is learned from the labelled rows among the stage's own input. Where none of them has a language and a letter,
    only null texts and texts without a letter go.
    """
    plain = base.positional(docs)
    text = F.col(f"col_{docs.columns.index('text')}")
    return plain.where(langid.decided(text, langid.train(docs))).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents that lose every word go."""
    return base.first_columns(linededup.dedup_lines(docs, drop_emptied=True), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one of smallest doc_id, then of smallest text hash."""
    found = simhash.near_duplicates(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"))
    return base.one_row_for_each(docs, first.select("m.doc_id", "m.key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a global shuffle."""
    return base.first_columns(mixing.mix_sources(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their place."""
    return packing.pack_documents(docs, cached=150_000)  # the workers also hold what earlier stages left behind


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder."""
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{base.run_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
