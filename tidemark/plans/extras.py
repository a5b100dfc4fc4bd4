"""Registered queries of the operators around the mart: as-of membership, prediction scores, folds, scalers, cleaning."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import grid
from tidemark.operators import asof, calendar, cleaning, descriptive, factors, folds, labels, membership, predictions, recurrences, scaling
from tidemark.operators.features import KEYS, published_features
from tidemark.functions.windows import led
from tidemark.operators.labels import LABEL
from tidemark.plans import oracle, testbed as tb
from tidemark.plans.catalog import _ALL, _MART_SOURCE, MIN_CS, ORACLE, QUERIES, SPLIT, _lagged_sql, _many_buckets, query, report, sreport, stage_daily_ic
from tidemark.session import run_folder, stage
from tidemark.sources import ingest
from tidemark.sources.schemas import DATASETS
from tidemark.plans.oracle import E, avg_rank, div, grid as sgrid, growth, lag, pct_rank, roll

# --- as-of joins ------------------------------------------------------------------------------------

# Membership files come every fourth month and not at all in 1996; two copies of a day differ in weight.
_FILED = "substr(trade_date, 5, 2) IN ('02', '06', '10') AND substr(trade_date, 1, 4) <> '1996'"
oracle.CTES["filed"] = (
    f"SELECT index_code, ts_code, trade_date, max(index_weight) AS index_weight FROM (SELECT index_code, ts_code, trade_date, index_weight FROM snapshots "
    f"UNION ALL SELECT index_code, ts_code, trade_date, index_weight / 2 FROM snapshots) WHERE {_FILED} GROUP BY ALL"
)
oracle.CTES["filed_days"] = "SELECT DISTINCT trade_date AS known_on FROM filed"
oracle.CTES["days_known"] = (
    "SELECT d.cal_date AS trade_date, f.known_on FROM open_days d ASOF JOIN filed_days f ON d.cal_date >= f.known_on "
    "WHERE strptime(d.cal_date, '%Y%m%d') - strptime(f.known_on, '%Y%m%d') <= INTERVAL 200 DAY"
)


def _filed(spark: SparkSession, folder: str) -> DataFrame:
    raw = tb.index_weight(spark, folder).where(_FILED)
    return membership.normalize_snapshots(raw.unionByName(raw.withColumn("weight", F.col("weight") / 2)), tb.INDEX_CODE)


def _index_days(spark: SparkSession, folder: str) -> DataFrame:
    opened = tb.open_days(tb.trade_calendar(spark, folder))
    return opened.select(F.lit(tb.INDEX_CODE).alias("index_code"), F.col("cal_date").alias("trade_date"))


@query(
    "membership_asof",
    sreport("(SELECT k.trade_date, f.index_code, f.ts_code, f.index_weight, k.known_on FROM days_known k JOIN filed f ON f.trade_date = k.known_on)",
            ["trade_date", "index_code", "ts_code", "known_on"], ["index_weight"]),
)
def membership_asof(spark, folder):
    """Members on every trading day: the last file's, at most 200 days old."""
    found = membership.membership_on(_index_days(spark, folder), _filed(spark, folder), max_age_days=200)
    return report(found, ["trade_date", "index_code", "ts_code", "known_on"], ["index_weight"])


# Flow is only known where buying clearly leads; a cell may be reported twice.
_LED = "buy_lg_amount > 3 * sell_lg_amount"
oracle.CTES["flow_known"] = f"SELECT ts_code, trade_date AS known_on, buy_lg_amount, net_mf_vol FROM wide WHERE {_LED}"
_FLOW_ASOF = (
    "SELECT w.trade_date, w.ts_code, CASE WHEN age <= 150 THEN known_on END AS known_on, CASE WHEN age <= 150 THEN buy_lg_amount END AS buy_lg_amount, "
    "CASE WHEN age <= 150 THEN net_mf_vol END AS net_mf_vol FROM (SELECT w.trade_date, w.ts_code, f.known_on, f.buy_lg_amount, f.net_mf_vol, "
    "date_diff('day', strptime(f.known_on, '%Y%m%d'), strptime(w.trade_date, '%Y%m%d')) AS age FROM wide w ASOF LEFT JOIN flow_known f "
    "ON w.ts_code = f.ts_code AND w.trade_date >= f.known_on) w"
)


@query("flow_asof", sreport(f"({_FLOW_ASOF})", [*KEYS, "known_on"], ["buy_lg_amount", "net_mf_vol"], digits=3))
def flow_asof(spark, folder):
    """Every cell with its entity's last known flow, at most 150 days old."""
    known = tb.wide(spark, folder).where(_LED).select(*KEYS, "buy_lg_amount", "net_mf_vol")
    twice = known.unionByName(known.withColumns({"buy_lg_amount": F.col("buy_lg_amount") / 2, "net_mf_vol": F.lit(0.0)}))
    cells = tb.wide(spark, folder).select(*KEYS)
    found = asof.asof_join(cells, twice, ["ts_code"], ["buy_lg_amount", "net_mf_vol"], max_age_days=150)
    return report(found, [*KEYS, "known_on"], ["buy_lg_amount", "net_mf_vol"], digits=3)


# --- recurrences ------------------------------------------------------------------------------------

oracle.CTES["rsv"] = f"SELECT trade_date, ts_code, 100 * {div(f'close - {roll('min', 'low', 9)}', f'{roll('max', 'high', 9)} - {roll('min', 'low', 9)}')} AS rsv FROM base_panel"


def _followed(x: str) -> str:
    seen = f"list({x}) OVER ({E} ROWS UNBOUNDED PRECEDING)"
    moved = "CASE WHEN x IS NULL THEN y ELSE y * 2 / 3 + x / 3 END"
    return f"CASE WHEN count({x}) OVER ({E} ROWS UNBOUNDED PRECEDING) > 0 THEN list_reduce(list_prepend(50::DOUBLE, {seen}), lambda y, x: {moved}) END"


oracle.CTES["kdj_k"] = f"SELECT *, {_followed('rsv')} AS k FROM rsv"
oracle.CTES["kdj"] = f"SELECT trade_date, ts_code, rsv AS kdj_rsv, k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j FROM (SELECT *, {_followed('k')} AS d FROM kdj_k)"
_KDJ = ["kdj_rsv", "kdj_k", "kdj_d", "kdj_j"]


@query("kdj", sreport("kdj", KEYS, _KDJ, digits=5))
def kdj(spark, folder):
    return report(recurrences.kdj(tb.panel(spark, folder).select(*KEYS, "high", "low", "close")), KEYS, _KDJ, digits=5)


# --- prediction scores ------------------------------------------------------------------------------

# A prediction on a coarse grid, so that many values tie; null where the history is short.
_SPLIT_OF = "CASE " + " ".join(f"WHEN trade_date BETWEEN '{a}' AND '{b}' THEN '{k}'" for k, (a, b) in reversed(SPLIT.items())) + " END"
oracle.CTES["predicted"] = (
    f"SELECT split, trade_date, ts_code, p, y FROM (SELECT {_SPLIT_OF} AS split, trade_date, ts_code, {sgrid('lag1_ret_5d_mean', 2)} AS p, label_rel_return AS y FROM ds) "
    "WHERE split IS NOT NULL AND p IS NOT NULL AND y IS NOT NULL"
)
oracle.CTES["predicted_daily"] = (
    "SELECT split, trade_date, " + div("covar_pop(p, y)", "stddev_pop(p) * stddev_pop(y)") + " AS ic, " + div("covar_pop(rp, ry)", "stddev_pop(rp) * stddev_pop(ry)")
    + f" AS rank_ic, count(*) AS n FROM (SELECT *, {avg_rank('p', 'split, trade_date')} AS rp, {avg_rank('y', 'split, trade_date')} AS ry FROM predicted) "
    f"GROUP BY ALL HAVING count(*) >= {MIN_CS}"
)
_SCORED = f"""(SELECT e.*, coalesce(days, 0) AS days, ic_mean, ic_std, icir, rank_ic_mean, rank_ic_std, rank_icir, positives, negatives, auc
FROM (SELECT split, count(*) AS rows, avg((p - y) * (p - y)) AS mse, avg(abs(p - y)) AS mae, avg(((p > 0) = (y > 0))::INT) AS accuracy FROM predicted GROUP BY ALL) e
LEFT JOIN (SELECT split, count(rank_ic) AS days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, {div('avg(ic)', 'stddev_samp(ic)')} AS icir, avg(rank_ic) AS rank_ic_mean,
    stddev_samp(rank_ic) AS rank_ic_std, {div('avg(rank_ic)', 'stddev_samp(rank_ic)')} AS rank_icir FROM predicted_daily GROUP BY ALL) d USING (split)
LEFT JOIN (SELECT split, count(*) FILTER (y > 0) AS positives, count(*) FILTER (NOT y > 0) AS negatives,
    (sum(rp) FILTER (y > 0) - positives * (positives + 1) / 2) / nullif(positives * negatives, 0) AS auc
    FROM (SELECT *, {avg_rank('p', 'split')} AS rp FROM predicted) GROUP BY ALL) a USING (split))"""
_SCORE_KEYS = ["split", "rows", "days", "positives", "negatives"]
_SCORE_VALUES = ["mse", "mae", "accuracy", "ic_mean", "ic_std", "icir", "rank_ic_mean", "rank_ic_std", "rank_icir", "auc"]


@query("prediction_scores", sreport(_SCORED, _SCORE_KEYS, _SCORE_VALUES))
def prediction_scores(spark, folder):
    split = F.expr(_SPLIT_OF)
    predicted = tb.dataset(spark, folder).select(*KEYS, split.alias("split"), grid("lag1_ret_5d_mean", 2).alias("p"), F.col(LABEL).alias("y"))
    return report(predictions.score(predicted, "p", "y", min_cross_section=MIN_CS), _SCORE_KEYS, _SCORE_VALUES)


# --- walk-forward folds -----------------------------------------------------------------------------

FIRST_TEST, TEST_DAYS, TRAIN_DAYS, HORIZON = "19970101", 9, 18, 5
oracle.CTES["fold_calendar"] = "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS place FROM (SELECT DISTINCT trade_date FROM base_panel)"
oracle.CTES["fold_table"] = (
    f"SELECT row_number() OVER (PARTITION BY scheme ORDER BY start) AS fold, * FROM (SELECT s.scheme, c.place AS start, c.trade_date AS test_from, "
    f"CASE WHEN scheme = 'rolling' THEN greatest(0, c.place - 1 - gap - {TRAIN_DAYS} + 1) ELSE 0 END AS train_from, c.place - 1 - gap AS train_to, "
    f"c.place + {TEST_DAYS} - 1 AS test_to FROM fold_calendar c, (VALUES ('expanding', 0), ('rolling', 1)) s(scheme, gap), "
    f"(SELECT count(*) FILTER (trade_date < '{FIRST_TEST}') AS f FROM fold_calendar) WHERE c.place >= f AND (c.place - f) % {TEST_DAYS} = 0) WHERE train_to >= train_from"
)
_FOLD_ROWS = f"""
SELECT p.trade_date, p.ts_code, t.scheme, t.fold::INT AS fold, CASE WHEN c.place >= t.start THEN 'test' ELSE 'train' END AS part
FROM (SELECT trade_date, ts_code, lead(trade_date, {HORIZON}) OVER (PARTITION BY ts_code ORDER BY trade_date) AS known_on FROM base_panel) p
JOIN fold_calendar c USING (trade_date) JOIN fold_table t ON c.place BETWEEN t.start AND t.test_to
    OR (c.place BETWEEN t.train_from AND t.train_to AND p.known_on < t.test_from)"""


def _schemes(spark: SparkSession, folder: str) -> DataFrame:
    rows = tb.panel(spark, folder).select(*KEYS)
    expanding = folds.walk_forward(rows, FIRST_TEST, TEST_DAYS, horizon=HORIZON).withColumn("scheme", F.lit("expanding"))
    rolling = folds.walk_forward(rows, FIRST_TEST, TEST_DAYS, TRAIN_DAYS, HORIZON, gap_days=1).withColumn("scheme", F.lit("rolling"))
    return expanding.unionByName(rolling).select(*KEYS, "scheme", "fold", "part")


query("walk_forward", _FOLD_ROWS)(_schemes)


@query(
    "walk_forward_summary",
    f"SELECT scheme, fold, part, count(*) AS rows, count(DISTINCT ts_code) AS entities, min(trade_date) AS first_day, max(trade_date) AS last_day FROM ({_FOLD_ROWS}) GROUP BY ALL",
)
def walk_forward_summary(spark, folder):
    return _schemes(spark, folder).groupBy("scheme", "fold", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ts_code").alias("entities"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")
    )


# --- scaling ----------------------------------------------------------------------------------------

SCALED = ["turnover_rate", "volume_ratio", "pe_ttm", "net_mf_vol"]
_SCALED_ROWS = " UNION ALL ".join(f"SELECT trade_date, ts_code, '{f}' AS feature, {f} AS x FROM base_panel" for f in SCALED)
oracle.CTES["scale_long"] = _SCALED_ROWS
oracle.CTES["date_medians"] = "SELECT trade_date, feature, median(x) AS center FROM scale_long GROUP BY ALL"
oracle.CTES["date_mads"] = "SELECT l.trade_date, l.feature, any_value(center) AS center, median(abs(x - center)) AS spread FROM scale_long l JOIN date_medians m ON m.trade_date = l.trade_date AND m.feature = l.feature GROUP BY ALL"


@query(
    "robust_z",
    sreport(f"(SELECT l.trade_date, l.ts_code, l.feature, CASE WHEN x IS NOT NULL AND spread <> 0 THEN least(10, greatest(-10, {div('x - center', 'spread')})) END AS z FROM scale_long l "
            "LEFT JOIN date_mads d ON d.trade_date = l.trade_date AND d.feature = l.feature)", [*KEYS, "feature"], ["z"], digits=5),
)
def robust_z(spark, folder):
    """Every value against its date's median and median absolute deviation, cut at ten."""
    return report(scaling.cross_section_z(tb.panel(spark, folder), SCALED, limit=10.0), [*KEYS, "feature"], ["z"], digits=5)


TRAINED_UNTIL = "19961231"
oracle.CTES["train_long"] = f"SELECT * FROM scale_long WHERE trade_date <= '{TRAINED_UNTIL}' AND x IS NOT NULL"
oracle.CTES["train_medians"] = "SELECT feature, median(x) AS center, count(*) AS n FROM train_long GROUP BY ALL"
oracle.CTES["robust_scaler"] = "SELECT l.feature, 'robust' AS method, any_value(center) AS center, median(abs(x - center)) AS spread, any_value(n) AS n FROM train_long l JOIN train_medians m ON m.feature = l.feature GROUP BY ALL"
oracle.CTES["scalers"] = "SELECT * FROM robust_scaler UNION ALL SELECT feature, 'standard', avg(x), stddev_samp(x), count(*) FROM train_long GROUP BY ALL"


def _scaler(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return scaling.fit_scaler(tb.panel(spark, folder).where(F.col("trade_date") <= TRAINED_UNTIL), SCALED, method)


@query("train_scaler", sreport("scalers", ["feature", "method", "n"], ["center", "spread"]))
def train_scaler(spark, folder):
    both = _scaler(spark, folder, scaling.ROBUST).unionByName(_scaler(spark, folder, scaling.STANDARD))
    return report(both, ["feature", "method", "n"], ["center", "spread"])


@query(
    "scaled_rows",
    "SELECT trade_date, ts_code, " + ", ".join(
        f"{sgrid(f'(SELECT {div(f'p.{f} - center', 'spread')} FROM scalers s WHERE s.feature = {chr(39)}{f}{chr(39)} AND s.method = {chr(39)}robust{chr(39)})', 5)} AS {f}" for f in SCALED
    ) + f" FROM base_panel p WHERE trade_date > '{TRAINED_UNTIL}'",
)
def scaled_rows(spark, folder):
    """Later rows by the scaler of the training rows."""
    later = tb.panel(spark, folder).where(F.col("trade_date") > TRAINED_UNTIL).select(*KEYS, *SCALED)
    return report(scaling.apply_scaler(later, _scaler(spark, folder, scaling.ROBUST)), KEYS, SCALED, digits=5)


# --- cleaning ---------------------------------------------------------------------------------------

# Every rule is broken by some rows, some rows break two.
_SPOILED = {
    "open": "CASE WHEN net_mf_vol = 0 THEN NULL ELSE open END",
    "close": "CASE WHEN ts_code LIKE '%3' AND trade_date LIKE '%0501' THEN -close ELSE close END",
    "low": "CASE WHEN ts_code LIKE '%7' AND trade_date LIKE '%0301' THEN high + 1 ELSE low END",
    "vol": "CASE WHEN ts_code LIKE '%3' AND trade_date LIKE '%0501' OR trade_date = '19970401' THEN -vol ELSE vol END",
}
_PRICES = ["trade_date", "ts_code", "open", "high", "low", "close", "pre_close", "vol", "amount"]
_spoiled = ", ".join(f"{_SPOILED.get(c, c)} AS {c}" for c in _PRICES)
oracle.CTES["spoiled"] = f"SELECT {_spoiled} FROM wide"
oracle.CTES["judged"] = "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{n}' END" for n, rule in cleaning.PRICE_RULES.items()) + "], lambda r: r IS NOT NULL) AS reasons FROM spoiled"


def _cleaned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return cleaning.clean(tb.wide(spark, folder).selectExpr(*[f"{_SPOILED.get(c, c)} AS {c}" for c in _PRICES]), watched=["open", "pre_close"])


@query("cleaned", sreport("judged", KEYS, _PRICES[2:], digits=4, where="WHERE len(reasons) = 0"))
def cleaned(spark, folder):
    return report(_cleaned(spark, folder)[0], KEYS, _PRICES[2:], digits=4)


_COUNTED = [("'rows'", "'before'", "count(*)"), ("'rows'", "'after'", "count(*) FILTER (len(reasons) = 0)")]
_COUNTED += [("'broken'", f"'{n}'", f"count(*) FILTER (list_contains(reasons, '{n}'))") for n in cleaning.PRICE_RULES]
_COUNTED += [("'removed'", f"'{n}'", f"count(*) FILTER (reasons[1] = '{n}')") for n in cleaning.PRICE_RULES]
_COUNTED += [("'missing_before'", f"'{c}'", f"count(*) FILTER ({c} IS NULL)") for c in ("open", "pre_close")]
_COUNTED += [("'missing_after'", f"'{c}'", f"count(*) FILTER ({c} IS NULL AND len(reasons) = 0)") for c in ("open", "pre_close")]


@query("cleaning_counts", " UNION ALL ".join(f"SELECT {s} AS section, {n} AS name, {c} AS rows FROM judged" for s, n, c in _COUNTED))
def cleaning_counts(spark, folder):
    return _cleaned(spark, folder)[1]


# --- label variants ---------------------------------------------------------------------------------

HORIZONS = (1, 5, 10)


def _forward_sql() -> str:
    ahead = lambda h: f"OVER ({E} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    cells = ["trade_date", "ts_code", "industry"]
    for h in HORIZONS:
        ret = growth(f"lead(close, {h}) OVER ({E})", "close")
        bench = f"(SELECT benchmark_future_return FROM bench_{h} b WHERE b.trade_date = p.trade_date)"
        full = f"CASE WHEN count(close) {ahead(h)} = {h} THEN"
        cells += [
            f"lead(trade_date, {h}) OVER ({E}) AS known_on_{h}", f"{ret} AS y_ret_{h}", f"({ret} > 0)::INT AS y_up_{h}",
            f"{full} {growth(f'min(close) {ahead(h)}', 'close')} END AS y_worst_{h}", f"{full} {growth(f'max(close) {ahead(h)}', 'close')} END AS y_best_{h}",
            f"{div(ret, f'CASE WHEN count(r) {ahead(h)} = {h} THEN stddev_samp(r) {ahead(h)} END * sqrt({h})')} AS y_risk_{h}",
            f"{ret} - {bench} AS y_excess_{h}", f"({ret} - {bench} > 0)::INT AS y_excess_up_{h}",
        ]
    return f"SELECT {', '.join(cells)} FROM (SELECT trade_date, ts_code, industry, close, {growth('close', lag('close', 1))} AS r FROM base_panel) p"


for _h in HORIZONS:
    oracle.CTES[f"bench_{_h}"] = f"SELECT trade_date, {growth(f'lead(close, {_h}) OVER (ORDER BY trade_date)', 'close')} AS benchmark_future_return FROM market"
oracle.CTES["forward_rows"] = _forward_sql()
oracle.CTES["forward_dates"] = "SELECT trade_date, quantile_cont(y_ret_5, 0.01) AS low, quantile_cont(y_ret_5, 0.99) AS high FROM forward_rows GROUP BY 1"
oracle.CTES["forward_industries"] = "SELECT trade_date, industry, avg(y_ret_5) AS mean FROM forward_rows GROUP BY ALL"
_DOWN = "(count(y_ret_5) OVER (PARTITION BY f.trade_date) + 1 - " + avg_rank("y_ret_5", "f.trade_date") + ") / count(y_ret_5) OVER (PARTITION BY f.trade_date)"
_FORWARD = (
    f"(SELECT f.*, {pct_rank('y_ret_5', 'f.trade_date')} AS y_rank, ({_DOWN} <= 0.2)::INT AS y_top, "
    "CASE WHEN y_ret_5 IS NOT NULL THEN least(high, greatest(low, y_ret_5)) END AS y_winsor, y_ret_5 - mean AS y_neutral "
    "FROM forward_rows f LEFT JOIN forward_dates d ON d.trade_date = f.trade_date LEFT JOIN forward_industries i ON i.trade_date = f.trade_date AND i.industry = f.industry)"
)
_FORWARD_VALUES = [f"y_{n}_{h}" for h in HORIZONS for n in ("ret", "worst", "best", "risk", "excess")] + ["y_rank", "y_winsor", "y_neutral"]
_FORWARD_KEYS = [*KEYS, *[f"known_on_{h}" for h in HORIZONS], *[f"y_{n}_{h}" for h in HORIZONS for n in ("up", "excess_up")], "y_top"]


def _forward(spark: SparkSession, folder: str, panel: DataFrame) -> DataFrame:
    market = tb.market(spark, folder)
    return labels.forward_labels(panel, {h: labels.benchmark_forward(market, tb.BENCHMARK, h) for h in HORIZONS}, HORIZONS)


def _label_panel(spark: SparkSession, folder: str) -> DataFrame:
    return tb.panel(spark, folder).select(*KEYS, "industry", "close")


@query("forward_labels", sreport(_FORWARD, _FORWARD_KEYS, _FORWARD_VALUES, digits=5))
def forward_labels(spark, folder):
    return report(_forward(spark, folder, _label_panel(spark, folder)), _FORWARD_KEYS, _FORWARD_VALUES, digits=5)


_LEAK_CUT = "19981201"


@query(
    "label_leaks",
    f"SELECT trade_date, ts_code, 'leaking' AS label FROM (SELECT *, lead(trade_date, 6) OVER ({E}) AS later, lead(trade_date, 5) OVER ({E}) AS known_on, "
    f"lead(close, 6) OVER ({E}) AS next_close FROM base_panel) WHERE trade_date <= '{_LEAK_CUT}' AND known_on <= '{_LEAK_CUT}' AND next_close IS NOT NULL AND later > '{_LEAK_CUT}'",
)
def label_leaks(spark, folder):
    """No label but one made to leak: it looks one row further than it is said to be known."""
    def build(panel: DataFrame) -> DataFrame:
        leaking = panel.select(*KEYS, led("close", 6).alias("leaking"))
        return _forward(spark, folder, panel).drop("industry", "close").join(leaking, KEYS)

    known = {f"y_{n}_{h}": f"known_on_{h}" for h in HORIZONS for n in ("ret", "up", "worst", "best", "risk", "excess", "excess_up")}
    return labels.label_leaks(build, _label_panel(spark, folder), _LEAK_CUT, known | {"leaking": "known_on_5"})


# --- descriptive tables and the calendar ------------------------------------------------------------

_BINS = 24
oracle.CTES["hist_long"] = " UNION ALL ".join(
    f"SELECT {_SPLIT_OF} AS split, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM ds" for c in (LABEL, "lag1_net_mf_amount_to_amount", "lag1_month")
)
oracle.CTES["hist_span"] = f'SELECT "column", min(x) AS low, max(x) AS high, (max(x) - min(x)) / {_BINS} AS width FROM hist_long GROUP BY 1'


@query(
    "label_histogram",
    f'SELECT split, "column", bin, {sgrid("CASE WHEN bin >= 0 THEN low + bin * width END")} AS low, {sgrid("CASE WHEN bin >= 0 THEN low + (bin + 1) * width END")} AS high, '
    f'count(*) AS rows FROM (SELECT l.split, l."column", s.low, s.width, CASE WHEN x IS NULL THEN -1 ELSE least(floor(coalesce({div("x - low", "width")}, 0)), {_BINS - 1}) END::INT AS bin '
    f'FROM hist_long l JOIN hist_span s ON s."column" = l."column") GROUP BY split, "column", bin, low, width',
)
def label_histogram(spark, folder):
    rows = tb.dataset(spark, folder).withColumn("split", F.expr(_SPLIT_OF))
    found = descriptive.histogram(rows, [LABEL, "lag1_net_mf_amount_to_amount", "lag1_month"], _BINS, ["split"])
    return report(found, ["split", "column", "bin", "rows"], ["low", "high"])


@query(
    "industry_counts",
    "SELECT trade_date, industry, count(*) AS rows, count(DISTINCT ts_code) AS entities, " + sgrid("count(*) / sum(count(*)) OVER (PARTITION BY trade_date)")
    + " AS share FROM base_panel GROUP BY trade_date, industry",
)
def industry_counts(spark, folder):
    return report(descriptive.group_sizes(tb.panel(spark, folder), ["trade_date", "industry"], ["trade_date"]), ["trade_date", "industry", "rows", "entities"], ["share"])


_CUMULATED = ["cumulative_ic", "cumulative_rank_ic"]


@query(
    "cumulative_ic",
    sreport("(SELECT trade_date, feature, sum(coalesce(ic, 0)) OVER w AS cumulative_ic, sum(coalesce(rank_ic, 0)) OVER w AS cumulative_rank_ic FROM dic "
            "WINDOW w AS (PARTITION BY feature ORDER BY trade_date ROWS UNBOUNDED PRECEDING))", ["trade_date", "feature"], _CUMULATED),
)
def cumulative_ic(spark, folder):
    return report(descriptive.cumulative_ic(stage_daily_ic(spark, folder)), ["trade_date", "feature"], _CUMULATED)


# Order days of the working week; early October, the first days of May and New Year are closed.
_WORKED = "dayofweek(o_orderdate) {week} AND NOT (month(o_orderdate) = 10 AND day(o_orderdate) <= 7) AND NOT (month(o_orderdate) = 5 AND day(o_orderdate) <= 3) AND NOT (month(o_orderdate) = 1 AND day(o_orderdate) <= 2)"
oracle.CTES["worked"] = "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS cal_date, o_orderdate::DATE AS d FROM orders WHERE " + _WORKED.format(week="BETWEEN 1 AND 5")
oracle.CTES["breaks"] = "SELECT before, d AS after FROM (SELECT d, lag(d) OVER (ORDER BY d) AS before FROM worked) WHERE date_diff('day', before, d) > 3"


@query(
    "holiday_distance",
    "SELECT w.cal_date, CASE WHEN s.after IS NOT NULL THEN (SELECT count(*) FROM worked v WHERE v.d BETWEEN s.after AND w.d) END::INT AS days_since_holiday, "
    "CASE WHEN e.before IS NOT NULL THEN (SELECT count(*) FROM worked v WHERE v.d BETWEEN w.d AND e.before) END::INT AS days_to_holiday FROM worked w "
    "ASOF LEFT JOIN breaks s ON w.d >= s.after ASOF LEFT JOIN breaks e ON w.d <= e.before",
)
def holiday_distance(spark, folder):
    days = tb.table(spark, folder, "orders").where(_WORKED.format(week="BETWEEN 2 AND 6")).select(F.date_format("o_orderdate", "yyyyMMdd").alias("cal_date"))
    return calendar.holiday_distance(days)


# --- correlation of all published features ----------------------------------------------------------

_EVERY = published_features()
oracle.CTES["full_ds"] = f"SELECT * FROM {_lagged_sql(_ALL, _MART_SOURCE)} WHERE label_rel_return IS NOT NULL"
oracle.CTES["full_long"] = (
    "SELECT trade_date, ts_code, feature, x FROM (SELECT trade_date, ts_code, unnest([" + ", ".join(f"'lag1_{c}'" for c in _EVERY) + "]) AS feature, unnest(["
    + ", ".join(f"CAST(lag1_{c} AS DOUBLE)" for c in _EVERY) + "]) AS x FROM full_ds) WHERE x IS NOT NULL"
)
oracle.CTES["full_pairs"] = (
    "SELECT a.feature AS feature_left, b.feature AS feature_right, a.x, b.x AS y FROM full_long a JOIN full_long b "
    "ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code AND list_position(getvariable_order, a.feature) < list_position(getvariable_order, b.feature)"
).replace("getvariable_order", "[" + ", ".join(f"'lag1_{c}'" for c in _EVERY) + "]")
_FULL_RANK = "rank() OVER (PARTITION BY feature_left, feature_right ORDER BY {v}) + (count(*) OVER (PARTITION BY feature_left, feature_right, {v}) - 1) / 2.0"


@query(
    "correlation_full",
    sreport(
        f"(SELECT feature_left, feature_right, {div('covar_pop(rx, ry)', 'stddev_pop(rx) * stddev_pop(ry)')} AS spearman_corr FROM (SELECT feature_left, feature_right, "
        f"{_FULL_RANK.format(v='x')} AS rx, {_FULL_RANK.format(v='y')} AS ry FROM full_pairs) GROUP BY ALL HAVING count(*) >= greatest(20, (SELECT count(*) FROM full_ds) // 100))",
        ["feature_left", "feature_right"], ["spearman_corr"], digits=5, where="WHERE spearman_corr IS NOT NULL",
    ),
)
def correlation_full(spark, folder):
    """Every pair of the published features over its own complete rows."""
    names = [f"lag1_{c}" for c in _EVERY]
    table = factors.correlation_pairs(tb.full_dataset(spark, folder), names, top_n=None)
    return report(table, ["feature_left", "feature_right"], ["spearman_corr"], digits=5)


# --- a second ingest run ----------------------------------------------------------------------------

# Daily files named by their date. The first run sees the months to 1998; until the second one, later months arrive and May files are
# revised by exchanging two prices, which keeps their length.
_HELD, _NEWER, _REVISED = ["open", "close", "vol"], "19990101", "trade_date LIKE '____05__'"
_WHOLE = {"open": "coalesce(floor(open * 100), 0)", "close": "floor(close * 100)", "vol": "floor(vol)"}


def _daily_text(spark: SparkSession, folder: str, revised: bool) -> DataFrame:
    whole = tb.daily(spark, folder).select(*KEYS, *[F.expr(f"CAST({_WHOLE[c]} AS BIGINT)").alias(c) for c in _HELD])
    turned = F.expr(_REVISED) if revised else F.lit(False)
    prices = {"open": F.when(turned, F.col("close")).otherwise(F.col("open")), "close": F.when(turned, F.col("open")).otherwise(F.col("close"))}
    return whole.withColumns(prices).select(*[F.col(c) if c in whole.columns else F.lit(0).alias(c) for c in DATASETS["daily"].columns])


def write_dated_files(rows: DataFrame, folder: str) -> None:
    """One CSV file YYYYMMDD.csv per trade_date, written by the tasks; only those whose content changes are touched."""
    system, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(place, recursive=True)
    names = rows.columns

    def write(day: pa.Table) -> pa.Table:
        day = day.sort_by("ts_code")
        date = day.column("trade_date")[0].as_py()
        lines = [",".join(names), *[",".join(map(str, r.values())) for r in day.select(names).to_pylist()]]
        blob, path = ("\n".join(lines) + "\n").encode(), f"{place}/{date}.csv"
        own, at = (fs.FileSystem.from_uri(folder)[0], path) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), path)
        with own.open_output_stream(at) as out:
            out.write(blob)
        return pa.table({"file": [path]})

    rows.groupBy("trade_date").applyInArrow(write, "file string").count()


def _second_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw rows, first run's registry rows, second run's) of daily files that changed between two runs."""
    root = f"{run_folder(spark)}/lake-{uuid.uuid4().hex}"
    kind = [DATASETS["daily"]]
    run = lambda: stage(ingest.ingest_all(spark, f"{root}/source", f"{root}/raw", f"{root}/registry", kind), "ingest-run")
    write_dated_files(_daily_text(spark, folder, False).where(F.col("trade_date") < _NEWER), f"{root}/source/daily")
    first = run()
    later = _daily_text(spark, folder, True).where(f"trade_date >= '{_NEWER}' OR {_REVISED}")
    write_dated_files(later, f"{root}/source/daily")
    second = run()
    registry = ingest.read_registry(spark, f"{root}/registry")
    return ingest.read_raw(spark, f"{root}/raw", registry, "daily"), first, second


oracle.CTES["dated"] = f"SELECT trade_date, ts_code, {', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _WHOLE.items())} FROM wide"
oracle.CTES["redated"] = f"SELECT trade_date, ts_code, vol, CASE WHEN {_REVISED} THEN close ELSE open END AS open, CASE WHEN {_REVISED} THEN open ELSE close END AS close FROM dated"


@query("ingest_second_run", "SELECT trade_date, ts_code, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close, CAST(vol AS DOUBLE) AS vol FROM redated")
def ingest_second_run(spark, folder):
    """What readers see after the second run: old, new and revised files, dates from file names."""
    return _second_run(spark, folder)[0].select(*KEYS, *_HELD)


_FILE_TEXT = f"md5('{','.join(DATASETS['daily'].columns)}' || chr(10) || string_agg(" + " || ',' || ".join(
    c if c in (*KEYS, *_HELD) else "'0'" for c in DATASETS["daily"].columns
) + " || chr(10), '' ORDER BY ts_code))"


@query(
    "ingest_runs",
    f"SELECT 1 AS run, trade_date || '.csv' AS filename, {_FILE_TEXT} AS md5, count(*) AS row_count, trade_date AS trade_date_min FROM dated WHERE trade_date < '{_NEWER}' GROUP BY trade_date "
    f"UNION ALL SELECT 2, trade_date || '.csv', {_FILE_TEXT}, count(*), trade_date FROM redated WHERE trade_date >= '{_NEWER}' OR {_REVISED} GROUP BY trade_date",
)
def ingest_runs(spark, folder):
    """The files each run took in: names, checksums, rows and dates."""
    _, first, second = _second_run(spark, folder)
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.select("run", "filename", "md5", "row_count", "trade_date_min")


for _name in ("prediction_scores", "robust_z", "train_scaler", "forward_labels"):
    QUERIES[f"{_name}_cut"] = _many_buckets(_name)
    ORACLE[f"{_name}_cut"] = ORACLE[_name]
