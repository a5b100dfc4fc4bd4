"""Raw datasets: file layout, where the date comes from, and column types."""

from __future__ import annotations

from dataclasses import dataclass

SINGLE, FILE_PER_DATE, INDEX_FILES, FILE_PER_SYMBOL = "single_file", "dated_files", "monthly_index_files", "symbol_files"


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    layout: str
    columns: dict[str, str]
    date_from: str = "none"  # none | column | filename
    date_column: str = "trade_date"

    @property
    def partition(self) -> str | None:
        """The column the raw table is partitioned by."""
        if self.date_from == "filename":
            return "trade_date"
        return "ts_code" if self.layout == FILE_PER_SYMBOL else None


# The raw datasets, their columns in file order and their types.
BASIC = {
    "ts_code": "string",
    "symbol": "string",
    "name": "string",
    "area": "string",
    "industry": "string",
    "cnspell": "string",
    "market": "string",
    "list_date": "date_yyyymmdd",
    "act_name": "string",
    "act_ent_type": "string",
}
TRADE_CAL = {
    "exchange": "string",
    "cal_date": "date_yyyymmdd",
    "is_open": "integer",
    "pretrade_date": "date_yyyymmdd",
}
DAILY = {
    "ts_code": "string",
    "trade_date": "date_yyyymmdd",
    "open": "numeric",
    "high": "numeric",
    "low": "numeric",
    "close": "numeric",
    "pre_close": "numeric",
    "change": "numeric",
    "pct_chg": "numeric",
    "vol": "numeric",
    "amount": "numeric",
    "vwap": "numeric",
}
STOCK_ST = {
    "ts_code": "string",
    "name": "string",
    "trade_date": "date_yyyymmdd",
    "type": "string",
    "type_name": "string",
}
INDEX_WEIGHT = {
    "index_code": "string",
    "con_code": "string",
    "trade_date": "date_yyyymmdd",
    "weight": "numeric",
}
METRIC = {
    "ts_code": "string",
    "trade_date": "date_yyyymmdd",
    "close": "numeric",
    "turnover_rate": "numeric",
    "turnover_rate_f": "numeric",
    "volume_ratio": "numeric",
    "pe": "numeric",
    "pe_ttm": "numeric",
    "pb": "numeric",
    "ps": "numeric",
    "ps_ttm": "numeric",
    "dv_ratio": "numeric",
    "dv_ttm": "numeric",
    "total_share": "numeric",
    "float_share": "numeric",
    "free_share": "numeric",
    "total_mv": "numeric",
    "circ_mv": "numeric",
}
MONEYFLOW = {
    "ts_code": "string",
    "trade_date": "date_yyyymmdd",
    "buy_sm_vol": "numeric",
    "buy_sm_amount": "numeric",
    "sell_sm_vol": "numeric",
    "sell_sm_amount": "numeric",
    "buy_md_vol": "numeric",
    "buy_md_amount": "numeric",
    "sell_md_vol": "numeric",
    "sell_md_amount": "numeric",
    "buy_lg_vol": "numeric",
    "buy_lg_amount": "numeric",
    "sell_lg_vol": "numeric",
    "sell_lg_amount": "numeric",
    "buy_elg_vol": "numeric",
    "buy_elg_amount": "numeric",
    "sell_elg_vol": "numeric",
    "sell_elg_amount": "numeric",
    "net_mf_vol": "numeric",
    "net_mf_amount": "numeric",
}
MARKET = {
    "ts_code": "string",
    "trade_date": "date_yyyymmdd",
    "close": "numeric",
    "open": "numeric",
    "high": "numeric",
    "low": "numeric",
    "pre_close": "numeric",
    "change": "numeric",
    "pct_chg": "numeric",
    "vol": "numeric",
    "amount": "numeric",
}

DATASETS = {
    d.name: d
    for d in [
        Dataset("basic", "basic.csv", SINGLE, BASIC),
        Dataset("trade_cal", "trade_cal.csv", SINGLE, TRADE_CAL, "column", "cal_date"),
        Dataset("daily", "daily", FILE_PER_DATE, DAILY, "filename"),
        Dataset("stock_st", "stock_st", FILE_PER_DATE, STOCK_ST, "filename"),
        Dataset("index_weight", "index_weight", INDEX_FILES, INDEX_WEIGHT, "column"),
        Dataset("metric", "metric", FILE_PER_DATE, METRIC, "filename"),
        Dataset("moneyflow", "moneyflow", FILE_PER_DATE, MONEYFLOW, "filename"),
        Dataset("market", "market", FILE_PER_SYMBOL, MARKET, "column"),
    ]
}

SPARK_TYPES = {"string": "string", "numeric": "double", "integer": "bigint", "date_yyyymmdd": "string"}

# CSV text read as a missing value.
NULL_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
