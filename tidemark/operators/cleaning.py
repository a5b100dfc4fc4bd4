"""Cleaning with an account of what was removed.

Rules are evaluated row by row in the pass that writes the cleaned table, and the counts are observed in that same pass: one scan, no
shuffle. A retried or speculative task is counted once, because Spark takes an observation from the task whose output it keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.functions.scalars import flag
from tidemark.session import run_folder

# The row checks of a price panel, in the order in which they are charged.
PRICE_RULES = {
    "missing_price": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL",
    "close_not_positive": "close <= 0",
    "high_below_low": "high < low",
    "negative_volume": "vol < 0",
}


def reasons(rules: dict[str, str | Column]) -> Column:
    """The names of all rules a row breaks, in rule order; a rule that is null does not count as broken."""
    hits = [F.when(flag(F.expr(rule) if isinstance(rule, str) else rule) == 1, F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*hits))


def clean(df: DataFrame, rules: dict[str, str | Column] = PRICE_RULES, watched: list[str] | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, and what happened to the others.

    The cleaned table is written to ``path`` (by default one of the session's own tables) and read back. The second table has one row for each
    (section, name): 'rows' before and after; per rule the rows that break it ('broken') and those removed that break no rule before it
    ('removed', which add up to the removed rows); per ``watched`` column its missing values 'missing_before' and 'missing_after'.
    """
    names, watched = list(rules), watched or []
    judged = df.withColumn("_reasons", reasons(rules))
    first, kept = F.get("_reasons", F.lit(0)), F.size("_reasons") == 0
    counts = {("rows", "before"): F.count(F.lit(1)), ("rows", "after"): F.count_if(kept)}
    counts |= {("broken", n): F.count_if(F.array_contains("_reasons", n)) for n in names}
    counts |= {("removed", n): F.count_if(F.coalesce(first == n, F.lit(False))) for n in names}
    counts |= {("missing_before", c): F.count_if(F.col(c).isNull()) for c in watched}
    counts |= {("missing_after", c): F.count_if(kept & F.col(c).isNull()) for c in watched}
    seen = Observation(f"cleaning-{uuid.uuid4().hex}")
    out = path or f"{run_folder(df.sparkSession)}/cleaned-{uuid.uuid4().hex}"
    watch = judged.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    watch.where(F.size("_reasons") == 0).drop("_reasons").write.mode("errorifexists").parquet(out)
    found = seen.get
    table = [(section, name, int(found[f"c{i}"] or 0)) for i, (section, name) in enumerate(counts)]
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(out), spark.createDataFrame(table, "section string, name string, rows long")
