"""Document quality rules whose limits adapt to each language and source.

Fixed base rules fail texts that are short or mostly repeated. For the others, ratios are compared with limits
taken from quantile sketches. A sketch of a metric is a table of counts by bin: bins are single values below 64 and have
a relative width of at most 1/32 above, so a metric has a bounded number of bins, sketches merge by adding counts, the
result does not depend on order, and a quantile is off by one bin at most. Sketches are kept per language and source, and
added up to languages and to the whole corpus; a group with fewer than ``least_rows`` rows takes its language's limits, then
the corpus's.

A metric's upper limit is its third quartile plus the larger of ``spread`` interquartile ranges and the metric's least
distance; word length has a lower limit likewise. Limits are joined to the documents, and a row outside any is not kept.

All per-row work is array functions inside one pass over the text. Repeated windows are found by sorting the hashes of a
text's windows, n log n in its length. Texts are never moved between tasks.

Null text has no words and fails. Null language or source is a group of its own. Rows are judged one by one, repeated
ones alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.pii import let

#: Metric, numerator and denominator (the metric is their ratio in ten-thousandths), least distance, has a lower limit.
METRICS = [
    ("word_length", "word_chars", "n_words", 10_000, True),
    ("symbols", "n_symbols", "word_chars", 400, False),
    ("dup_lines", "n_dup_lines", "n_lines", 4_000, False),
    ("repeats", "n_repeat_words", "n_words", 3_000, False),
]
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    spaced = F.translate(text, base.SPACES[1:], " " * (len(base.SPACES) - 1))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more."""

    def of_hashes(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        windows = F.zip_with(pairs, F.slice(h, 3, n), lambda p, c: F.xxhash64(p["a"], p["b"], c))
        return let(F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("h"), i.alias("i")))), of_sorted)

    def of_sorted(s: Column) -> Column:
        m = F.greatest(F.size(s) - 1, F.lit(0))
        equal = F.zip_with(F.slice(s, 1, m), F.slice(s, 2, m), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return let(F.sort_array(F.flatten(F.filter(equal, lambda p: p.isNotNull()))), covered)

    def covered(places: Column) -> Column:
        after = F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))
        steps = F.zip_with(places, after, lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return F.when(F.size(words) < 4, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def measures(text: Column) -> Column:
    """Struct of a whole text's counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, base.SPACES, "") != "")
    dup = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    chars, symbols = F.char_length(F.translate(text, base.SPACES, "")), F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return let(F.struct(words.alias("w"), dup.alias("d")), lambda x: F.struct(
        x["w"]["n"].cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        x["d"]["n"].cast("long").alias("n_lines"), x["d"]["dup"].cast("long").alias("n_dup_lines"), x["w"]["repeat"].cast("long").alias("n_repeat_words"),
    ))


def bin_top(value: Column) -> Column:
    """The largest whole number of a number's bin: itself below 64, else all but its leading six bits set."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), low).cast("long")
    return F.floor(value / width).cast("long") * width + width - 1


def _limits(sketch: DataFrame, group: list[str], spread: int) -> DataFrame:
    """Limits of each group and metric from counts by bin: (*group, metric, n, low, high)."""
    up = Window.partitionBy(*group, "metric").orderBy("top")
    whole = Window.partitionBy(*group, "metric")
    ranked = sketch.withColumns({"seen": F.sum("n").over(up), "total": F.sum("n").over(whole)})
    quarter = lambda q: F.min(F.when(4 * F.col("seen") >= q * F.col("total"), F.col("top")))
    found = ranked.groupBy(*group, "metric").agg(F.sum("n").alias("n"), quarter(1).alias("q1"), quarter(3).alias("q3"))
    least = F.create_map(*[x for m in METRICS for x in (F.lit(m[0]), F.lit(m[3]).cast("long"))])
    reach = F.greatest(spread * (F.col("q3") - F.col("q1")), least[F.col("metric")])
    return found.select(*group, "metric", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def apply_rules(docs: DataFrame, spread: int = 3, least_rows: int = 200, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, outside, kept).

    ``outside`` lists the metrics that broke a limit.
    """
    rows = base.pick(docs, "doc_id", "text", "lang", "source")
    counted = base.stage(rows.select("doc_id", "lang", "source", measures(F.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*"), "measures")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    name = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))
    metrics = {m: F.floor(10_000 * F.col(top) / F.greatest(F.col(below), F.lit(1))).cast("long") for m, top, below, _, _ in METRICS}
    judged = counted.withColumns({"base_failed": failed, "in_lang": name("lang"), "in_source": name("source")} | metrics)

    pairs = F.explode(F.array(*[F.struct(F.lit(m[0]).alias("metric"), bin_top(F.col(m[0])).alias("top")) for m in METRICS]))
    passed = judged.where(~F.col("base_failed")).select("in_lang", "in_source", pairs.alias("p"))
    sketch = base.stage(passed.groupBy("in_lang", "in_source", "p.metric", "p.top").agg(F.count("*").alias("n")), "sketches")
    merged = lambda *group: sketch.groupBy(*group, "metric", "top").agg(F.sum("n").alias("n"))
    fine = _limits(sketch, ["in_lang", "in_source"], spread)
    coarse = _limits(merged("in_lang"), ["in_lang"], spread).select("in_lang", "metric", *[F.col(c).alias(f"{c}_lang") for c in ("n", "low", "high")])
    whole = _limits(merged(), [], spread).select("metric", *[F.col(c).alias(f"{c}_all") for c in ("low", "high")])
    every = fine.join(coarse, ["in_lang", "metric"]).join(F.broadcast(whole), "metric")  # one row for each metric
    chosen = lambda c: F.when(F.col("n") >= least_rows, F.col(c)).when(F.col("n_lang") >= least_rows, F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all"))
    limits = every.select("in_lang", "in_source", "metric", chosen("low").alias("low"), chosen("high").alias("high"))
    cells = [F.max(F.when(F.col("metric") == m[0], F.col(c))).alias(f"{m[0]}_{c}") for m in METRICS for c in ("low", "high")]
    table = base.stage(limits.groupBy("in_lang", "in_source").agg(*cells), "limits")

    outside = F.array(*[F.when((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low") if two_sided else F.lit(False)), F.lit(m)) for m, _, _, _, two_sided in METRICS])
    joined = judged.join(table, ["in_lang", "in_source"], "left").withColumn("outside", F.filter(outside, lambda x: x.isNotNull()))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "outside",
        (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"),
    )


#: Counts of each row in DuckDB SQL, up to the table ``counted``.
COUNTED_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    CASE WHEN lang IS NULL THEN '-' ELSE '+' || lang END AS in_lang, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS in_source FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM rows)),
sized AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM words GROUP BY r),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM (
    SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM rows)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (SELECT doc_id, in_lang, in_source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM rows LEFT JOIN sized USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r))
"""

#: The op2 query in DuckDB SQL, with the default parameters.
SQL = COUNTED_SQL + r""",
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10000 * word_chars // greatest(n_words, 1) AS word_length,
    10000 * n_symbols // greatest(word_chars, 1) AS symbols, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 10000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM counted),
long AS (UNPIVOT (SELECT in_lang, in_source, word_length, symbols, dup_lines, repeats FROM judged WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeats INTO NAME metric VALUE value),
binned AS (SELECT in_lang, in_source, metric, (value // w) * w + w - 1 AS top FROM (SELECT *, (1::BIGINT << greatest(length(ltrim(bin(value), '0')) - 6, 0)::BIGINT) AS w FROM long)),
levels AS (SELECT in_lang, in_source, metric, top, 2 AS depth FROM binned UNION ALL SELECT in_lang, NULL, metric, top, 1 FROM binned UNION ALL SELECT NULL, NULL, metric, top, 0 FROM binned),
ranked AS (SELECT *, row_number() OVER (PARTITION BY depth, in_lang, in_source, metric ORDER BY top) AS seen, count(*) OVER (PARTITION BY depth, in_lang, in_source, metric) AS n FROM levels),
quartiles AS (SELECT depth, in_lang, in_source, metric, max(n) AS n, min(top) FILTER (4 * seen >= n) AS q1, min(top) FILTER (4 * seen >= 3 * n) AS q3 FROM ranked GROUP BY ALL),
limits AS (SELECT depth, in_lang, in_source, metric, n, q1 - reach AS low, q3 + reach AS high FROM (SELECT *, greatest(3 * (q3 - q1),
    CASE metric WHEN 'word_length' THEN 10000 WHEN 'symbols' THEN 400 WHEN 'dup_lines' THEN 4000 ELSE 3000 END) AS reach FROM quartiles)),
chosen AS (SELECT f.in_lang, f.in_source, f.metric, CASE WHEN f.n >= 200 THEN f.low WHEN l.n >= 200 THEN l.low ELSE a.low END AS low, CASE WHEN f.n >= 200 THEN f.high WHEN l.n >= 200 THEN l.high ELSE a.high END AS high
    FROM limits f JOIN limits l ON l.depth = 1 AND l.in_lang = f.in_lang AND l.metric = f.metric JOIN limits a ON a.depth = 0 AND a.metric = f.metric WHERE f.depth = 2),
wide AS (SELECT in_lang, in_source, max(low) FILTER (metric = 'word_length') AS length_low, max(high) FILTER (metric = 'word_length') AS length_high, max(high) FILTER (metric = 'symbols') AS symbols_high,
    max(high) FILTER (metric = 'dup_lines') AS dup_high, max(high) FILTER (metric = 'repeats') AS repeats_high FROM chosen GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_length BETWEEN length_low AND length_high AND symbols <= symbols_high AND dup_lines <= dup_high AND repeats <= repeats_high AS kept
FROM judged LEFT JOIN wide USING (in_lang, in_source)
"""
