"""What the operators of this package share: input columns by exact name, row keys, tables kept between jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root, run_folder, stage

__all__ = ["checkpoint_root", "documents", "pick", "positional", "run_folder", "stage", "text_key"]

#: Characters of a word, as a Java and a Python pattern: all but space and the ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def positional(df: DataFrame, prefix: str = "col_") -> DataFrame:
    """The same columns renamed by position, so that names of the input cannot clash with those of an operator."""
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, whatever other columns the input holds."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    plain = positional(df)
    return plain.select(*[F.col(f"col_{df.columns.index(n)}").alias(n) for n in names])


def first_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The first columns by position, under their names, where an operator has appended others of any name."""
    return positional(df).select(*[f"col_{i}" for i in range(len(names))]).toDF(*names)


def one_row_for_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_key) in ``keys`` (columns doc_id and key), with its columns.

    Rows that agree in both hold the same text; which of them stays shows in other columns at most.
    """
    plain = positional(docs)
    doc_id, text = (F.col(f"col_{docs.columns.index(n)}") for n in ("doc_id", "text"))
    keyed = plain.withColumn("key", text_key(text))
    wanted = keys.select(F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"))
    kept = keyed.join(wanted, doc_id.eqNullSafe(F.col("wanted_id")) & F.col("key").eqNullSafe(F.col("wanted_key")), "left_semi")
    once = kept.dropDuplicates([f"col_{docs.columns.index('doc_id')}", "key"])
    return once.drop("key").toDF(*docs.columns)


def text_key(text: Column) -> Column:
    """A stable 64-bit key of a text, used only to order or tell apart rows that share a doc_id."""
    return F.xxhash64(text)
