"""Time-ordered helpers over one entity's history.

The panel holds one row per (entity, day) - ``operators.panel.latest`` enforces it - so a history is at
most one row per calendar day and a window over it stays small however large the panel grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ENTITY = "ts_code"
DATE = "trade_date"


def over(frame: str = "", entity: str = ENTITY, date: str = DATE) -> str:
    """SQL text of a window over an entity's history. Library features are many, and one parsed expression
    is much cheaper to build than a tree of column calls."""
    return f"OVER (PARTITION BY `{entity}` ORDER BY `{date}` {frame})"


def trailing(n: int, entity: str = ENTITY, date: str = DATE) -> str:
    """The current row and the n-1 rows before it."""
    return over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW", entity, date)


def default_min_obs(n: int) -> int:
    return max(2, n // 2)


def rolling(fn: str, c: str, n: int, min_obs: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """Aggregate ``fn`` of SQL expression ``c`` over the last n rows, null with fewer than ``min_obs``
    non-null values."""
    w = trailing(n, entity, date)
    need = default_min_obs(n) if min_obs is None else min_obs
    return F.expr(f"CASE WHEN count({c}) {w} >= {need} THEN {fn}({c}) {w} END")


def with_rolled(df: DataFrame, wanted: dict[str, tuple[str, str, int, int]], entity: str = ENTITY, date: str = DATE) -> DataFrame:
    """Add many rolling columns: name -> (fn, column, n, min_obs).

    Each (fn, column, n) and each count is evaluated once, whatever the number of columns that use it, and
    all of them on one sort.
    """
    raw: dict[tuple[str, str, int], str] = {}
    for fn, c, n, _ in wanted.values():
        for key in ((fn, c, n), ("count", c, n)):
            raw.setdefault(key, f"_r{len(raw)}")
    out = df.withColumns({name: F.expr(f"{fn}(`{c}`) {trailing(n, entity, date)}") for (fn, c, n), name in raw.items()})
    guarded = {
        name: F.expr(f"CASE WHEN {raw['count', c, n]} >= {need} THEN {raw[fn, c, n]} END")
        for name, (fn, c, n, need) in wanted.items()
    }
    return out.withColumns(guarded).drop(*raw.values())


def lagged(c: str, k: int, entity: str = ENTITY, date: str = DATE) -> Column:
    return F.expr(f"lag({c}, {k}) {over('', entity, date)}")


def led(c: str, k: int, entity: str = ENTITY, date: str = DATE) -> Column:
    return F.expr(f"lead({c}, {k}) {over('', entity, date)}")


def rolling_rank_pct(c: str, n: int, min_obs: int, entity: str = ENTITY, date: str = DATE) -> Column:
    """Average-tie percentile rank of the current value among the last n rows."""
    seen = F.expr(f"collect_list({c}) {trailing(n, entity, date)}")
    x = F.expr(c)
    below = F.size(F.filter(seen, lambda v: v < x))
    same = F.size(F.filter(seen, lambda v: v == x))
    rank = F.try_divide(below + (same + 1) / 2.0, F.size(seen))
    return F.when(x.isNotNull() & (F.size(seen) >= min_obs), rank)


def trailing_matrix(columns: list[str], n: int, entity: str = ENTITY, date: str = DATE) -> Column:
    """The last n rows of ``columns`` as array<array<float>>; null when short or when any cell is null."""
    row = ", ".join(f"CAST(`{c}` AS FLOAT)" for c in columns)
    rows = F.expr(f"collect_list(array({row})) {trailing(n, entity, date)}")
    complete = (F.size(rows) == n) & ~F.exists(rows, lambda r: F.exists(r, lambda v: v.isNull()))
    return F.when(complete, rows)
