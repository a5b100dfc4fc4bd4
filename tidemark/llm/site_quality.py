"""Document quality from a document's own evidence and its site's record, by hierarchical empirical Bayes.

Evidence: a text's counts are put on short scales. For each step of each scale, the log ratio of its shares among good
and bad labelled documents (add-one smoothed) is the evidence; a document's evidence is the sum.

Sites: of the labelled documents of a host, and of a path within a host, the good ones are counted. A host's rate is a
beta-binomial posterior mean whose prior is the global rate; a path's rate has its host's as prior. The prior strengths
are estimated from the spread between hosts, and between paths within hosts, by moments: where sites differ little, or
have few labels, they shrink toward the level above. A labelled document's own label is taken out of its path's
rate, so labels do not predict themselves.

The log odds of the path's rate plus the document's evidence give the score, the probability of being good.

All steps are grouped aggregations with map-side combining and joins of narrow rows; texts are read once and never moved. The
tables of steps are bounded by the scales. Sites number at most the documents' hosts and paths, and are joined by Spark's
size check.

Null text counts as empty. Null host or path is a site of its own. Labels outside 0 and 1 are ignored; of several
labels for a doc_id the majority counts, good on a tie. Rows with equal doc_id are scored one by one. Without labels every score is one half.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.quality_rules import COUNTED_SQL, measures

SCALES = ["size", "length", "symbols", "dup_lines", "repeats"]
_LIMIT = 1e6


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and host with first path segment of a web address; both null if there is no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return host, F.concat(host, F.lit("/"), first)


def _scales() -> dict[str, Column]:
    """Steps of each scale: bit lengths for counts, parts of a ratio elsewhere."""
    part = lambda times, a, b: F.floor(times * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "size": F.length(F.bin("n_words")).cast("long"),
        "length": F.least(part(2, "word_chars", "n_words"), F.lit(40).cast("long")),
        "symbols": F.length(F.bin(part(1000, "n_symbols", "word_chars"))).cast("long"),
        "dup_lines": part(10, "n_dup_lines", "n_lines"),
        "repeats": part(10, "n_repeat_words", "n_words"),
    }


def _strength(rate: float, spread: float, groups: float, total: float, squares: float) -> float:
    """Prior strength from the labelled-weighted squared differences ``spread`` of group rates, by moments."""
    noise = rate * (1 - rate)
    room = total - squares / total if total else 0.0
    between = (spread - groups * noise) / room if room > 0 else 0.0
    return _LIMIT if between <= noise / _LIMIT else min(_LIMIT, max(1.0, noise / between - 1))


def _evidence(rows: DataFrame) -> DataFrame:
    """(scale, step, evidence) over all labelled rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(s).alias("step")) for s in SCALES]))
    counts = rows.where("good is not null").select(pairs.alias("p"), "good").groupBy("p.scale", "p.step").agg(F.sum("good").alias("n1"), F.sum(1 - F.col("good")).alias("n0"))
    counts = base.stage(counts, "steps")
    totals = counts.groupBy("scale").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count("*").alias("steps"))
    ratio = F.log((F.col("n1") + 1) / (F.col("t1") + F.col("steps"))) - F.log((F.col("n0") + 1) / (F.col("t0") + F.col("steps")))
    return counts.join(totals, "scale").select("scale", "step", ratio.alias("evidence"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, site_cols: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, kept) of each row.

    ``host`` and ``path`` are string columns over doc_id, text and ``site_cols``; ``labels`` has doc_id and quality (1
    good, 0 bad).
    """
    name = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))
    sited = base.pick(docs, "doc_id", "text", *site_cols).select("doc_id", "text", host.alias("host"), path.alias("path"))
    counted = sited.select("doc_id", name(F.col("host")).alias("host"), name(F.col("path")).alias("path"), measures(F.col("text")).alias("m")).select("doc_id", "host", "path", "m.*")
    graded = base.pick(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null")
    graded = graded.groupBy("doc_id").agg((2 * F.sum("quality") >= F.count("*")).cast("long").alias("good"))
    rows = base.stage(counted.join(graded, "doc_id", "left").select("doc_id", "host", "path", "good", *[c.alias(s) for s, c in _scales().items()]), "graded")

    known = rows.where("good is not null")
    paths = base.stage(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")), "paths")
    hosts = base.stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("paths")), "hosts")
    total, good, n_hosts, squares = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()
    rate = (good + 1) / (total + 2)
    spread = hosts.agg(F.coalesce(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)), F.lit(0.0))).first()[0]
    strength = _strength(rate, spread, n_hosts - 1, total, squares)
    hosts = hosts.withColumn("host_rate", (F.col("s") + strength * rate) / (F.col("n") + strength)).select("host", "host_rate", F.col("n").alias("in_host"), F.col("s").alias("of_host"))
    within = paths.join(hosts, "host").withColumn("raw", F.col("of_host") / F.col("in_host"))
    inner, lost, n_paths = within.agg(
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("raw"), 2)), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n") / F.col("in_host")), F.lit(0.0)), F.count("*"),
    ).first()
    path_strength = _strength(rate, inner, n_paths - n_hosts, total, lost * total)
    sites = paths.join(hosts, "host").select("host", "path", "n", "s", "host_rate")

    evidence = _evidence(rows)
    table = {f"{scale}:{step}": e for scale, step, e in evidence.collect()}  # bounded by the scales
    lookup = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, v)]) if table else F.create_map().cast("map<string,double>")
    parts = [F.coalesce(F.try_element_at(lookup, F.concat(F.lit(f"{s}:"), F.col(s).cast("string"))), F.lit(0.0)) for s in SCALES]
    own = F.coalesce("good", F.lit(0))
    one = F.col("good").isNotNull().cast("long")
    joined = rows.withColumn("evidence", sum(parts[1:], parts[0])).join(sites, ["host", "path"], "left").join(hosts.select("host", F.col("host_rate").alias("of_host")), "host", "left")
    host_rate = F.coalesce("host_rate", "of_host", F.lit(rate))
    path_rate = (F.coalesce("s", F.lit(0)) - own + path_strength * F.col("above")) / (F.coalesce("n", F.lit(0)) - one + path_strength)
    rated = joined.withColumn("above", host_rate).withColumn("path_rate", path_rate)
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    scored = rated.select("doc_id", "evidence", F.col("above").alias("host_rate"), "path_rate", score.alias("score"))
    return scored.withColumn("kept", F.col("score") >= threshold)


#: The op9 query in DuckDB SQL: host is the source, path the source and language.
SQL = COUNTED_SQL + r""",
graded AS (SELECT doc_id, (2 * sum(quality) >= count(*))::BIGINT AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
scaled AS (SELECT c.doc_id, c.in_source AS host, '+' || substr(c.in_source, 2) || '/' || substr(c.in_lang, 2) AS path, g.good, length(ltrim(bin(n_words), '0')) + (n_words = 0)::INT AS size,
    least(2 * word_chars // greatest(n_words, 1), 40) AS length, length(ltrim(bin(1000 * n_symbols // greatest(word_chars, 1)), '0')) + (1000 * n_symbols < greatest(word_chars, 1))::INT AS symbols,
    10 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 10 * n_repeat_words // greatest(n_words, 1) AS repeats FROM counted c LEFT JOIN graded g USING (doc_id)),
known AS (SELECT * FROM scaled WHERE good IS NOT NULL),
steps AS (SELECT scale, step, sum(good) AS n1, sum(1 - good) AS n0 FROM (
    SELECT 'size' AS scale, size AS step, good FROM known UNION ALL SELECT 'length', length, good FROM known UNION ALL SELECT 'symbols', symbols, good FROM known
    UNION ALL SELECT 'dup_lines', dup_lines, good FROM known UNION ALL SELECT 'repeats', repeats, good FROM known) GROUP BY ALL),
evidence AS (SELECT scale, step, ln((n1 + 1) / (t1 + k)) - ln((n0 + 1) / (t0 + k)) AS e FROM (SELECT *, sum(n1) OVER w AS t1, sum(n0) OVER w AS t0, count(*) OVER w AS k FROM steps WINDOW w AS (PARTITION BY scale))),
paths AS (SELECT host, path, count(*) AS n, sum(good) AS s FROM known GROUP BY ALL),
hosts0 AS (SELECT host, sum(n) AS n, sum(s) AS s FROM paths GROUP BY host),
all0 AS (SELECT sum(n) AS total, (sum(s) + 1) / (sum(n) + 2) AS rate, count(*) AS g, sum(n::DOUBLE * n) AS squares FROM hosts0),
all1 AS (SELECT *, (sum_sq - (g - 1) * rate * (1 - rate)) / (total - squares / total) AS tau FROM all0, (SELECT sum(n * pow(s / n - (SELECT rate FROM all0), 2)) AS sum_sq FROM hosts0)),
all2 AS (SELECT *, CASE WHEN coalesce(tau, 0) <= rate * (1 - rate) / 1e6 THEN 1e6 ELSE least(1e6, greatest(1, rate * (1 - rate) / tau - 1)) END AS k FROM all1),
hosts AS (SELECT host, n, s, (s + k * rate) / (n + k) AS host_rate FROM hosts0, all2),
all3 AS (SELECT rate, total, (sum(p.n * pow(p.s / p.n - h.s / h.n, 2)) - (count(*) - any_value(g)) * rate * (1 - rate)) / (total - sum(p.n::DOUBLE * p.n / h.n)) AS tau FROM paths p JOIN hosts h USING (host), all2 GROUP BY rate, total),
all4 AS (SELECT *, CASE WHEN coalesce(tau, 0) <= rate * (1 - rate) / 1e6 THEN 1e6 ELSE least(1e6, greatest(1, rate * (1 - rate) / tau - 1)) END AS k FROM all3),
scored AS (SELECT x.doc_id, coalesce(e1.e, 0) + coalesce(e2.e, 0) + coalesce(e3.e, 0) + coalesce(e4.e, 0) + coalesce(e5.e, 0) AS evidence, coalesce(h.host_rate, a.rate) AS host_rate,
    (coalesce(p.s, 0) - coalesce(x.good, 0) + a.k * coalesce(h.host_rate, a.rate)) / (coalesce(p.n, 0) - (x.good IS NOT NULL)::INT + a.k) AS path_rate
    FROM scaled x CROSS JOIN all4 a LEFT JOIN paths p USING (host, path) LEFT JOIN hosts h USING (host)
    LEFT JOIN evidence e1 ON e1.scale = 'size' AND e1.step = x.size LEFT JOIN evidence e2 ON e2.scale = 'length' AND e2.step = x.length LEFT JOIN evidence e3 ON e3.scale = 'symbols' AND e3.step = x.symbols
    LEFT JOIN evidence e4 ON e4.scale = 'dup_lines' AND e4.step = x.dup_lines LEFT JOIN evidence e5 ON e5.scale = 'repeats' AND e5.step = x.repeats)
SELECT doc_id, round(evidence, 6) AS evidence, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate, round(1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))), 6) AS score,
    evidence + ln(path_rate / (1 - path_rate)) >= 0 AS kept FROM scored
"""
