"""The registered queries as plain SQL, for comparison on the same tables.

``CTES`` names building blocks in dependency order; ``with_ctes`` puts the ones a query needs in front.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from tidemark.functions.scalars import GRID_OFFSET
from tidemark.plans import testbed

E = "PARTITION BY ts_code ORDER BY trade_date"


def grid(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expr}) * {scale} + {GRID_OFFSET}) / {scale}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def growth(a: str, b: str) -> str:
    return f"({div(a, b)} - 1)"


def roll(fn: str, expr: str, n: int, need: int | None = None) -> str:
    need = max(2, n // 2) if need is None else need
    frame = f"OVER ({E} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({expr}) {frame} >= {need} THEN {fn}({expr}) {frame} END)"


def lag(expr: str, k: int) -> str:
    return f"lag({expr}, {k}) OVER ({E})"


def avg_rank(value: str, keys: str) -> str:
    """Average rank of non-null values, null for null."""
    return (
        f"(CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 END)"
    )


def pct_rank(value: str, keys: str) -> str:
    return f"({avg_rank(value, keys)} / nullif(count({value}) OVER (PARTITION BY {keys}), 0))"


def _dec(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def _side(flag: str, large: bool, column: str = "l_extendedprice") -> str:
    extra = " AND l_quantity >= 25" if large else ""
    return f"coalesce(sum(CASE WHEN l_returnflag = '{flag}'{extra} THEN {_dec(column)} END), 0)"


CTES: dict[str, str] = {}

CTES["cells"] = f"""
SELECT strftime(l_shipdate, '%Y%m') || '01' AS trade_date,
       'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS ts_code,
       CAST(sum({_dec('l_quantity')}) AS DOUBLE) AS vol,
       sum({_dec('l_extendedprice')}) AS amount_dec,
       CAST(sum({_dec('l_extendedprice')}) AS DOUBLE) AS amount,
       CAST(sum({_dec('l_extendedprice')}) AS DOUBLE) / CAST(sum({_dec('l_quantity')}) AS DOUBLE) AS close,
       CAST(sum(CASE WHEN day(l_shipdate) <= 10 THEN {_dec('l_extendedprice')} END) AS DOUBLE)
         / CAST(sum(CASE WHEN day(l_shipdate) <= 10 THEN {_dec('l_quantity')} END) AS DOUBLE) AS open,
       max(l_extendedprice / l_quantity) AS high,
       min(l_extendedprice / l_quantity) AS low,
       count(*) AS lines,
       CAST(sum({_dec('l_extendedprice')} * {_dec('l_tax')}) AS DOUBLE) AS tax_amount,
       CAST(sum({_dec('l_extendedprice')} * {_dec('l_discount')}) AS DOUBLE) AS discount_amount,
       CAST({_side('N', True)} AS DOUBLE) AS buy_lg_amount,
       CAST({_side('R', True)} AS DOUBLE) AS sell_lg_amount,
       CAST({_side('N', False)} AS DOUBLE) AS n_amount,
       CAST({_side('R', False)} AS DOUBLE) AS r_amount,
       CAST({_side('N', False, 'l_quantity')} - {_side('R', False, 'l_quantity')} AS DOUBLE) AS net_mf_vol
FROM lineitem GROUP BY 1, 2"""

CTES["nation_mv"] = """
SELECT s_nationkey, trade_date,
       CAST(sum(nation_amount) OVER (PARTITION BY s_nationkey ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total_mv
FROM (SELECT s.s_nationkey, c.trade_date, sum(c.amount_dec) AS nation_amount
      FROM cells c JOIN supplier s ON c.ts_code = 'S' || lpad(CAST(s.s_suppkey AS VARCHAR), 5, '0') GROUP BY 1, 2)"""

CTES["wide"] = f"""
SELECT c.trade_date, c.ts_code, open, high, low, close, {lag('close', 1)} AS pre_close, vol, amount,
       {div('vol', f'avg(vol) OVER ({E} ROWS UNBOUNDED PRECEDING)')} AS turnover_rate,
       vol / CAST(lines AS DOUBLE) AS turnover_rate_f,
       {div('vol', lag('vol', 1))} AS volume_ratio,
       {div('amount', 'tax_amount')} AS pe_ttm, {div('amount', 'discount_amount')} AS pb, {div('close', 'high')} AS ps_ttm,
       n.total_mv,
       CAST(sum(amount_dec) OVER ({E} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS circ_mv,
       n_amount - r_amount AS net_mf_amount, net_mf_vol, buy_lg_amount, sell_lg_amount
FROM (SELECT c.*, s.s_nationkey FROM cells c
      LEFT JOIN supplier s ON c.ts_code = 'S' || lpad(CAST(s.s_suppkey AS VARCHAR), 5, '0')) c
LEFT JOIN nation_mv n ON n.s_nationkey = c.s_nationkey AND n.trade_date = c.trade_date""".replace(
    "PARTITION BY ts_code ORDER BY trade_date", "PARTITION BY c.ts_code ORDER BY c.trade_date"
)

CTES["basic"] = """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ts_code, s_name AS name,
       CASE WHEN s_suppkey % 23 <> 0 THEN r_name END AS industry, n_name AS market,
       CASE WHEN s_suppkey % 17 <> 0 THEN strftime(first_ship, '%Y%m%d') END AS list_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) f ON s_suppkey = l_suppkey"""

CTES["base_panel"] = """
SELECT w.*, coalesce(b.industry, 'UNKNOWN') AS industry, coalesce(b.market, 'UNKNOWN') AS market, b.list_date
FROM wide w LEFT JOIN basic b ON w.ts_code = b.ts_code"""

CTES["market"] = f"""
SELECT '{testbed.BENCHMARK}' AS ts_code, trade_date, amount, vol, amount / vol AS close,
       lag(amount / vol) OVER (ORDER BY trade_date) AS pre_close
FROM (SELECT trade_date, CAST(sum(amount_dec) AS DOUBLE) AS amount, CAST(sum(CAST(vol AS DECIMAL(18,2))) AS DOUBLE) AS vol
      FROM cells GROUP BY 1)"""

CTES["bench"] = f"SELECT trade_date, {growth('close', 'pre_close')} AS benchmark_ret_1d FROM market"

CTES["bench_fwd"] = (
    "SELECT trade_date, " + growth("lead(close, 5) OVER (ORDER BY trade_date)", "close") + " AS benchmark_future_return FROM market"
)

CTES["trade_cal"] = """
SELECT DISTINCT strftime(l_shipdate, '%Y%m') || '01' AS cal_date, 1 AS is_open FROM lineitem
UNION ALL
SELECT DISTINCT strftime(o_orderdate, '%Y%m%d'), 0 FROM orders WHERE day(o_orderdate) <> 1"""

CTES["open_days"] = """
SELECT cal_date, row_number() OVER (ORDER BY cal_date) - 1 AS trade_index
FROM (SELECT DISTINCT cal_date FROM trade_cal WHERE is_open = 1)"""

CTES["snapshots"] = f"""
SELECT '{testbed.INDEX_CODE}' AS index_code, ts_code, trade_date, amount / total AS index_weight
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount_dec DESC, ts_code) AS place,
             CAST(sum(amount_dec) OVER (PARTITION BY trade_date) AS DOUBLE) AS total FROM cells)
WHERE place <= {testbed.INDEX_SIZE}"""

CTES["intervals"] = """
SELECT index_code, ts_code, min(trade_date) AS effective_from,
       CASE WHEN max(place) = max(last_place) THEN '99991231' ELSE max(trade_date) END AS effective_to,
       arg_max(index_weight, trade_date) AS index_weight, max(trade_date) AS source_trade_date,
       max(place) = max(last_place) AS is_active
FROM (SELECT s.*, d.place, d.last_place,
             d.place - row_number() OVER (PARTITION BY s.index_code, s.ts_code ORDER BY s.trade_date) AS island
      FROM snapshots s
      JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS place, count(*) OVER () AS last_place
            FROM (SELECT DISTINCT trade_date FROM snapshots)) d ON s.trade_date = d.trade_date)
GROUP BY index_code, ts_code, island"""

CTES["st_list"] = "SELECT trade_date, ts_code FROM cells WHERE r_amount > 0.6 * amount"

CTES["listed"] = """
SELECT p.trade_date, p.ts_code, p.list_date,
       greatest(coalesce(o.trade_index - l.next_index + 1, 0), 0) AS listed_days
FROM base_panel p
LEFT JOIN open_days o ON o.cal_date = p.trade_date
LEFT JOIN (SELECT d.list_date, count(o.cal_date) AS next_index
           FROM (SELECT DISTINCT list_date FROM basic WHERE list_date IS NOT NULL) d
           LEFT JOIN open_days o ON o.cal_date < d.list_date GROUP BY 1) l ON l.list_date = p.list_date"""


def _rule_rows() -> str:
    rows = []
    for board, rule in testbed.LIMIT_RULES["boards"].items():
        reforms = rule["reforms"]
        for i, r in enumerate(reforms):
            start = "00000000" if i == 0 else r["effective_from"]
            end = reforms[i + 1]["effective_from"] if i + 1 < len(reforms) else "99999999"
            rows.append(
                f"('{board}', '{r['effective_from']}', '{start}', '{end}', CAST({r['normal_limit_ratio']} AS DOUBLE), "
                f"CAST({r['st_limit_ratio']} AS DOUBLE), {r['ipo_no_limit_trading_days']})"
            )
    return ", ".join(rows)


CTES["rules"] = (
    f"SELECT * FROM (VALUES {_rule_rows()}) t(board, reform_from, valid_from, valid_before, normal_ratio, st_ratio, ipo_days)"
)

CTES["ruled"] = """
SELECT p.*, l.listed_days, s.ts_code IS NOT NULL AS is_st, b.market_board, r.*
FROM base_panel p
JOIN listed l ON l.trade_date = p.trade_date AND l.ts_code = p.ts_code
LEFT JOIN st_list s ON s.trade_date = p.trade_date AND s.ts_code = p.ts_code
JOIN (SELECT ts_code, CASE WHEN regexp_matches(ts_code, '^S\\d{4}[3-5]$') THEN 'mid'
                           WHEN regexp_matches(ts_code, '^S\\d{4}[0-2]$') THEN 'low'
                           ELSE 'unknown' END AS market_board FROM basic) b ON b.ts_code = p.ts_code
LEFT JOIN rules r ON r.board = b.market_board AND p.trade_date >= r.valid_from AND p.trade_date < r.valid_before"""

CTES["limited"] = """
SELECT *, NOT free AS has_price_limit,
       CASE WHEN NOT free AND pre_close > 0 THEN round_even(pre_close * (1 + limit_ratio) / 0.01, 0) * 0.01 END AS limit_up_price,
       CASE WHEN NOT free AND pre_close > 0 THEN round_even(pre_close * (1 - limit_ratio) / 0.01, 0) * 0.01 END AS limit_down_price
FROM (SELECT *, listed_days <= ipo_days AS free,
             CASE WHEN listed_days <= ipo_days THEN NULL WHEN is_st THEN st_ratio ELSE normal_ratio END AS limit_ratio,
             CASE WHEN listed_days <= ipo_days THEN market_board || '_' || trade_date || '_ipo_no_limit'
                  WHEN is_st THEN market_board || '_' || reform_from || '_st'
                  ELSE market_board || '_' || reform_from || '_normal' END AS limit_rule_id,
             CASE WHEN listed_days <= ipo_days THEN 'first_' || ipo_days || '_trading_days_no_limit'
                  WHEN is_st THEN 'risk_warning_limit' ELSE 'normal_limit' END AS limit_rule_reason
      FROM ruled)"""

CTES["state"] = """
SELECT trade_date, ts_code, is_st, NOT volume_valid AS is_suspended,
       coalesce(close >= limit_up_price - 0.000001, false) AS is_limit_up,
       coalesce(close <= limit_down_price + 0.000001, false) AS is_limit_down,
       NOT is_st AND volume_valid AND price_valid AS is_tradable,
       listed_days, listed_days AS listed_trading_days, market_board, has_price_limit, limit_ratio, limit_up_price,
       limit_down_price, limit_rule_id, limit_rule_reason, volume_valid, price_valid, 'v1' AS state_version
FROM (SELECT *, coalesce(vol > 0, false) AS volume_valid,
             open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND pre_close IS NOT NULL
               AND close > 0 AS price_valid FROM limited)"""

CTES["tradable_panel"] = """
SELECT p.*, s.is_limit_up, s.is_limit_down, s.has_price_limit, s.limit_ratio, s.limit_up_price, s.limit_down_price,
       s.listed_trading_days
FROM base_panel p JOIN state s ON s.trade_date = p.trade_date AND s.ts_code = p.ts_code WHERE s.is_tradable"""


# --- features over a source panel -------------------------------------------------------------------

ROW_FEATURES = {
    "ret_1d": growth("close", "pre_close"),
    "amount_log": "ln(1 + greatest(coalesce(amount, 0), 0))",
    "vol_log": "ln(1 + greatest(coalesce(vol, 0), 0))",
    "log_total_mv": "ln(1 + (CASE WHEN total_mv IS NOT NULL THEN greatest(total_mv, 0) END))",
    "log_circ_mv": "ln(1 + (CASE WHEN circ_mv IS NOT NULL THEN greatest(circ_mv, 0) END))",
    "net_mf_amount_to_amount": div("net_mf_amount", "amount"),
    "large_order_imbalance": div("buy_lg_amount - sell_lg_amount", "buy_lg_amount + sell_lg_amount"),
    "main_mf_strength": div("buy_lg_amount - sell_lg_amount", "amount"),
    "turnover_cost_proxy": div("turnover_rate", "ln(1 + greatest(coalesce(amount, 0), 0))"),
    "illiquidity_proxy": div(f"abs({growth('close', 'pre_close')})", "amount"),
    "amplitude": div("high - low", "pre_close"),
    "close_position": div("close - low", "high - low"),
    "upper_shadow_ratio": div("high - greatest(open, close)", "pre_close"),
    "lower_shadow_ratio": div("least(open, close) - low", "pre_close"),
    "gap_open": growth("open", "pre_close"),
    "intraday_return": growth("close", "open"),
    "weekday": "CAST((dayofweek(strptime(trade_date, '%Y%m%d')) + 6) % 7 AS INTEGER)",
    "month": "CAST(month(strptime(trade_date, '%Y%m%d')) AS INTEGER)",
    "is_month_end": "strptime(trade_date, '%Y%m%d') = last_day(strptime(trade_date, '%Y%m%d'))",
}
LIMIT_FEATURES = {
    "dist_to_limit_up": growth("limit_up_price", "close"),
    "dist_to_limit_down": growth("close", "limit_down_price"),
    "limit_position": div("close - limit_down_price", "limit_up_price - limit_down_price"),
    "near_limit_up_2pct": f"CASE WHEN {growth('limit_up_price', 'close')} <= 0.02 THEN 1 ELSE 0 END",
    "near_limit_down_2pct": f"CASE WHEN {growth('close', 'limit_down_price')} <= 0.02 THEN 1 ELSE 0 END",
    "limit_touch_up": "CASE WHEN high >= limit_up_price THEN 1 ELSE 0 END",
    "limit_touch_down": "CASE WHEN low <= limit_down_price THEN 1 ELSE 0 END",
}


def _named(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _beta(n: int) -> str:
    need = max(10, n // 2)
    m = lambda x: roll("avg", x, n, need)
    x, y = "benchmark_ret_1d", "ret_1d"
    return div(f"{m(f'{x} * {y}')} - {m(x)} * {m(y)}", f"{m(f'{x} * {x}')} - {m(x)} * {m(x)}")


def _winsor(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.01) OVER (PARTITION BY trade_date)), "
        f"quantile_cont({c}, 0.99) OVER (PARTITION BY trade_date)) END AS {c}_winsor"
    )


def _history_features() -> dict[str, str]:
    ma5, ma20, ma60 = roll("avg", "close", 5, 3), roll("avg", "close", 20, 10), roll("avg", "close", 60, 30)
    gain = "(CASE WHEN ret_1d IS NOT NULL THEN greatest(ret_1d, 0) END)"
    loss = "(CASE WHEN ret_1d IS NOT NULL THEN greatest(-ret_1d, 0) END)"
    peak = roll("max", "close", 20, 10)
    out = {
        "ret_5d": growth("close", lag("close", 5)),
        "ret_20d": growth("close", lag("close", 20)),
        "rsi_14d": f"100 - 100 / (1 + {div(roll('avg', gain, 14, 7), roll('avg', loss, 14, 7))})",
        "ma_ratio_5_20": growth(ma5, ma20),
        "ma_ratio_20_60": growth(ma20, ma60),
        "price_to_ma20": growth("close", ma20),
        "bollinger_z_20d": div(f"close - {ma20}", roll("stddev_samp", "close", 20, 10)),
        "max_drawdown_20d": growth("close", peak),
        "new_high_20d": f"CASE WHEN close >= {peak} THEN 1 ELSE 0 END",
        "turnover_acceleration": growth("turnover_rate", roll("avg", "turnover_rate", 20, 10)),
        "industry_neutral_ret_20d": roll("avg", "industry_neutral_ret_1d", 20, 10),
    }
    for n in (5, 10, 20, 60):
        out[f"ret_{n}d_mean"] = roll("avg", "ret_1d", n)
        out[f"ret_{n}d_std"] = roll("stddev_samp", "ret_1d", n)
        out[f"amount_{n}d_mean"] = roll("avg", "amount", n)
        out[f"turnover_{n}d_mean"] = roll("avg", "turnover_rate", n)
        out[f"turnover_{n}d_std"] = roll("stddev_samp", "turnover_rate", n)
        out[f"net_mf_strength_{n}d_mean"] = roll("avg", "net_mf_amount_to_amount", n)
        out[f"excess_ret_{n}d_mean"] = roll("avg", "excess_ret_1d", n)
    for n in (20, 60):
        out[f"beta_{n}d"] = _beta(n)
        out[f"residual_ret_{n}d"] = f"ret_1d - {_beta(n)} * benchmark_ret_1d"
    return out


HISTORY_FEATURES = _history_features()

_MOMENT = "PARTITION BY trade_date, industry"


def _add_feature_ctes(prefix: str, source: str, limits: bool) -> None:
    """Register ``<prefix>_row``, ``_cross``, ``_hist``: the three feature stages over ``source``."""
    extra = ", " + _named(LIMIT_FEATURES) if limits else ""
    CTES[f"{prefix}_row"] = f"SELECT *, {_named(ROW_FEATURES)}{extra} FROM {source}"
    CTES[f"{prefix}_bench"] = (
        f"SELECT r.*, b.benchmark_ret_1d, r.ret_1d - b.benchmark_ret_1d AS excess_ret_1d, "
        f"avg(r.ret_1d) OVER (PARTITION BY r.trade_date, r.industry) AS industry_ret_1d_mean, "
        f"r.ret_1d - avg(r.ret_1d) OVER (PARTITION BY r.trade_date, r.industry) AS industry_neutral_ret_1d, "
        f"{', '.join(_winsor(c) for c in ('pe_ttm', 'pb', 'ps_ttm'))} "
        f"FROM {prefix}_row r LEFT JOIN bench b ON b.trade_date = r.trade_date"
    ).replace("OVER (PARTITION BY trade_date)", "OVER (PARTITION BY r.trade_date)")
    flow = "net_mf_amount_to_amount"
    CTES[f"{prefix}_cross"] = (
        f"SELECT *, {pct_rank('amount', 'trade_date')} AS amount_rank_pct, "
        f"{pct_rank('turnover_rate', 'trade_date, industry')} AS industry_turnover_rank, "
        f"{pct_rank('amount', 'trade_date, industry')} AS industry_amount_rank, "
        f"{pct_rank('pb_winsor', 'trade_date, industry')} AS industry_pb_rank, "
        f"{pct_rank('circ_mv', 'trade_date, industry')} AS industry_mv_rank, "
        f"{pct_rank(flow, 'trade_date, industry')} AS industry_net_mf_strength_rank, "
        f"avg({flow}) OVER ({_MOMENT}) AS industry_net_mf_strength_mean, "
        f"avg(CASE WHEN {flow} > 0 THEN 1.0 ELSE 0.0 END) OVER ({_MOMENT}) AS industry_net_mf_positive_ratio "
        f"FROM {prefix}_bench"
    )
    CTES[f"{prefix}_hist"] = f"SELECT *, {_named(HISTORY_FEATURES)} FROM {prefix}_cross"
    # exponential means written out as weighted sums over the entity's past rows
    CTES[f"{prefix}_seq"] = f"SELECT ts_code, trade_date, close, row_number() OVER ({E}) - 1 AS k FROM {source}"

    def weighted(x: str, span: int, first: str) -> str:
        a = 2.0 / (span + 1)
        return f"sum(b.{x} * pow(1 - {a}, a.k - b.k) * CASE WHEN b.k = {first} THEN 1 ELSE {a} END)"

    CTES[f"{prefix}_diff"] = (
        f"SELECT a.ts_code, a.trade_date, a.k, CASE WHEN a.k >= 25 THEN {weighted('close', 12, '0')} - {weighted('close', 26, '0')} END AS diff "
        f"FROM {prefix}_seq a JOIN {prefix}_seq b ON a.ts_code = b.ts_code AND b.k <= a.k GROUP BY 1, 2, 3"
    )
    CTES[f"{prefix}_macd"] = (
        f"SELECT a.ts_code, a.trade_date, a.diff AS macd_diff, CASE WHEN a.k >= 33 THEN {weighted('diff', 9, '25')} END AS macd_dea "
        f"FROM {prefix}_diff a LEFT JOIN {prefix}_diff b ON a.ts_code = b.ts_code AND b.k <= a.k AND b.k >= 25 "
        f"GROUP BY a.ts_code, a.trade_date, a.diff, a.k"
    )


_add_feature_ctes("base", "base_panel", limits=False)
_add_feature_ctes("trad", "tradable_panel", limits=True)


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the building blocks it uses, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def copy_over(names: Sequence[str], suffix: str, source: str, body: str) -> None:
    """Register ``body`` as ``<source><suffix>`` and copies of the named blocks that read it."""
    CTES[f"{source}{suffix}"] = body
    known = "|".join([source, *names])
    for name in names:
        CTES[f"{name}{suffix}"] = re.sub(rf"\b({known})\b(?!')", rf"\1{suffix}", CTES[name])
