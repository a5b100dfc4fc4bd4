"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of all characters, over its present share. Each row draws a number of
copies from the Poisson distribution with that mean, by inverting the distribution function at a uniform number hashed
from the seed and the row's id. Copies are then dealt and sorted by a second hash, which mixes all sources globally. Draws need no
state and no order, so a task that runs again draws the same.

Sources are counted by one combining aggregation and their tables of the distribution are joined back (one row each), so
a source with a third of all rows is dealt like any other; its rows never meet in a task.

``weights`` are relative; sources that it leaves out get none. Without it, a source's weight is the ``power``-th power of its
characters (0.5 lifts small sources, 1 leaves the mix as it is). ``size`` is the mixed corpus's length in characters,
relative to the input.

Null source is a source of its own (key None). A source without any character keeps rate ``size`` times its weight
ratio of one. Null text counts no characters. A row's draw hashes doc_id, or its text where doc_id is null; rows that
share it draw alike. An empty table gives no rows. All columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(sizes: DataFrame, weights: dict[str | None, float] | None, power: float, size: float) -> DataFrame:
    """(source, rate) from (source, chars): the mean number of copies of each row."""
    name = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("-" if k is None else f"+{k}", float(w))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, name), F.lit(0.0))
    weighted = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    weights_sum, chars_sum = weighted.agg(F.sum("weight"), F.sum("chars")).first()
    share = F.col("weight") / weights_sum if weights_sum else F.lit(0.0)
    rate = F.when(F.col("chars") > 0, share * size * F.lit(chars_sum).cast("double") / F.col("chars")).otherwise(F.lit(float(size)))
    return weighted.select("source", rate.alias("rate"))


def distributions(rated: DataFrame) -> DataFrame:
    """(source, below): the Poisson distribution function at 0, 1, 2, ... up to where it is 1 in doubles."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 25).cast("int")
    steps = rated.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    up = Window.partitionBy("source").orderBy("k")
    logs = steps.withColumn("log_factorial", F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(up))
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = logs.withColumn("below", F.sum(mass).over(up))
    return summed.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "below"))), lambda s: s["below"]).alias("below"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    size: float = 1.0,
    source_col: str = "source",
    seed: int = 11,
) -> DataFrame:
    """The input's columns, then ``copy`` (from 1) and ``place``, the hash that the mixed rows are sorted by."""
    names = docs.columns
    sizes = base.pick(docs, source_col, "text").toDF("source", "text").groupBy("source").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
    table = base.stage(distributions(rates(base.stage(sizes, "source-sizes"), weights, power, size)), "source-rates")
    plain = base.positional(docs)
    col = {n: F.col(f"col_{names.index(n)}") for n in ("doc_id", "text", source_col)}
    keyed = plain.withColumns({"key": F.coalesce(col["doc_id"].cast("string"), F.md5(col["text"]), F.lit("")), "source": col[source_col]})
    drawn = keyed.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    u = uniform(F.col("key"), f"{seed}:count")
    copies = F.size(F.filter(F.transform("below", lambda b: u >= b), lambda hit: hit))
    spread = drawn.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    placed = spread.withColumn("place", uniform(F.concat("key", F.lit(":"), F.col("copy").cast("string")), f"{seed}:place"))
    mixed = placed.select(*[F.col(f"col_{i}") for i in range(len(names))], "copy", "place").repartition("place").sortWithinPartitions("place")
    return mixed.toDF(*names, "copy", "place")


#: The op7 query in DuckDB SQL, with the default parameters.
SQL = r"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source),
weighted AS (SELECT source, chars, CASE WHEN chars > 0 THEN sqrt(chars::DOUBLE) ELSE 0 END AS weight FROM sizes),
rated AS (SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars) FROM weighted)::DOUBLE / chars ELSE 1.0 END AS rate FROM weighted),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT + 1)) AS k FROM rated),
logs AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_factorial FROM steps),
below AS (SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS below FROM logs),
drawn AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, md5(text), '') AS key,
    ('0x' || substr(md5('11:count:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT / 4503599627370496 AS u FROM documents),
counted AS (SELECT d.*, (SELECT count(*) FROM below b WHERE b.source IS NOT DISTINCT FROM d.source AND d.u >= b.below) AS copies FROM drawn d)
SELECT doc_id, source, copy::INTEGER AS copy, ('0x' || substr(md5('11:place:' || key || ':' || copy), 1, 13))::BIGINT / 4503599627370496 AS place, text
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""
