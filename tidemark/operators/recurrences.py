"""Linear recurrences over an entity's history: y[t] = a[t] y[t-1] + b[t], in time linear in the history.

Each step is an affine map, and maps compose. A history is cut into blocks of ``BLOCK`` rows. Inside a block the map from the block's start to a row
comes from two running sums, of ln(a) and of b over the product of a; a block is short, so the product stays far from underflow. The
maps of whole blocks are folded in order, one step per block, and every row adds its block's start value times its own factor. Only
(entity, date) and the columns of the recurrence take part, however wide the panel is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import sdiv
from tidemark.functions.windows import DATE, ENTITY, rolling
from tidemark.session import stage

BLOCK = 64


def affine_scan(rows: DataFrame, maps: dict[str, tuple[Column, Column]], start: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with a column per map (a, b): the recurrence's value, from ``start`` (by default 0) before the first row.

    Neither a nor b may be null, and the product of the factors of ``BLOCK`` following rows must lie within 1e-280 and 1e280. ``rows`` has one row
    per (entity, date).
    """
    start = start or {}
    history = Window.partitionBy(ENTITY).orderBy(DATE)
    inside = Window.partitionBy(ENTITY, "_block").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_{p}_{n}": c for n, m in maps.items() for p, c in zip("ab", m, strict=True)})
    out = out.withColumn("_block", F.floor((F.row_number().over(history) - 1) / BLOCK))
    out = out.withColumns({f"_a_{n}": F.exp(F.sum(F.log(f"_a_{n}")).over(inside)) for n in maps})
    out = out.withColumns({f"_b_{n}": F.col(f"_a_{n}") * F.sum(F.col(f"_b_{n}") / F.col(f"_a_{n}")).over(inside) for n in maps})

    pieces = [F.col(f"_{p}_{n}").alias(f"{p}_{n}") for n in maps for p in "ab"]
    ends = out.groupBy(ENTITY, "_block").agg(F.max_by(F.struct(*pieces), DATE).alias("m"))
    blocks = ends.groupBy(ENTITY).agg(F.sort_array(F.collect_list(F.struct("_block", "m"))).alias("blocks"))
    first = F.struct(*[F.lit(float(start.get(n, 0.0))).alias(n) for n in maps])
    none = F.array().cast(f"array<struct<_block:bigint,{','.join(f'_y_{n}:double' for n in maps)}>>")

    def step(state: Column, block: Column) -> Column:
        m, y = block["m"], state["y"]
        entry = F.struct(block["_block"].alias("_block"), *[y[n].alias(f"_y_{n}") for n in maps])
        after = F.struct(*[(m[f"a_{n}"] * y[n] + m[f"b_{n}"]).alias(n) for n in maps])
        return F.struct(after.alias("y"), F.concat(state["starts"], F.array(entry)).alias("starts"))  # one entry per BLOCK rows

    folded = F.aggregate("blocks", F.struct(first.alias("y"), none.alias("starts")), step, lambda s: s["starts"])
    starts = blocks.select(ENTITY, F.inline(folded))
    joined = out.join(starts, [ENTITY, "_block"])
    return joined.select(*rows.columns, *[(F.col(f"_b_{n}") + F.col(f"_a_{n}") * F.col(f"_y_{n}")).alias(n) for n in maps])


def with_ema(rows: DataFrame, wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add exponential means: name -> (column, span, min_obs).

    A mean starts at the column's first value; over a gap the old mean's weight decays once per skipped row; null until ``min_obs`` values were
    seen. ``rows`` should be narrow: they are read twice.
    """
    if min(span for _, span, _ in wanted.values()) < 2:
        raise ValueError("a span is 2 at least")
    history = Window.partitionBy(ENTITY).orderBy(DATE)
    columns = sorted({c for c, _, _ in wanted.values()})
    out = rows.withColumn("_k", F.row_number().over(history))
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_last_{c}": F.max(F.when(F.col(c).isNotNull(), F.col("_k"))).over(before) for c in columns})
    out = out.withColumns({f"_seen_{c}": F.count(c).over(history.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})

    def affine(c: str, span: int) -> tuple[Column, Column]:
        alpha = 2.0 / (span + 1.0)
        x, gap = F.col(c), F.col("_k") - F.col(f"_last_{c}")
        decayed = F.pow(F.lit(1.0 - alpha), gap)
        factor = F.when(x.isNull() | gap.isNull(), 1.0).when(gap == 1, 1.0 - alpha).otherwise(decayed / (decayed + alpha))
        added = F.when(x.isNull(), 0.0).when(gap.isNull(), x).when(gap == 1, alpha * x).otherwise(alpha * x / (decayed + alpha))
        # over a very long gap the old mean no longer counts; its factor stays above zero, as its logarithm is taken
        return F.greatest(factor, F.lit(1e-100)), added

    scanned = affine_scan(out, {f"_ema_{n}": affine(c, span) for n, (c, span, _) in wanted.items()})
    shown = {n: F.when(F.col(f"_seen_{c}") >= need, F.col(f"_ema_{n}")) for n, (c, _, need) in wanted.items()}
    return scanned.select(*rows.columns, *[c.alias(n) for n, c in shown.items()])


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(entity, date, macd_diff, macd_dea, macd_hist) of prices (entity, date, close)."""
    means = with_ema(prices.select(ENTITY, DATE, "close"), {"_fast": ("close", fast, fast), "_slow": ("close", slow, slow)})
    diffs = stage(means.select(ENTITY, DATE, (F.col("_fast") - F.col("_slow")).alias("macd_diff")), "macd-diff")
    both = with_ema(diffs, {"macd_dea": ("macd_diff", signal, signal)})
    return both.withColumn("macd_hist", 2 * (F.col("macd_diff") - F.col("macd_dea")))


def kdj(prices: DataFrame, n: int = 9, smooth: int = 3, min_obs: int | None = None) -> DataFrame:
    """(entity, date, kdj_rsv, kdj_k, kdj_d, kdj_j) of prices (entity, date, high, low, close).

    RSV is the close's place between the lowest low and the highest high of ``n`` rows, in percent; K and D follow it with weight
    1/``smooth`` from 50 on, over unknown values unchanged; J = 3 K - 2 D. All but RSV are null before the first known one.
    """
    share = 1.0 / smooth
    low, high = rolling("min", "low", n, min_obs), rolling("max", "high", n, min_obs)
    rsv = 100 * sdiv(F.col("close") - low, high - low)
    rows = prices.select(ENTITY, DATE, rsv.alias("kdj_rsv"))

    def follow(df: DataFrame, c: str, name: str) -> DataFrame:
        x = F.col(c)
        moved = (F.when(x.isNull(), 1.0).otherwise(1.0 - share), F.when(x.isNull(), 0.0).otherwise(share * x))
        known = F.count(c).over(Window.partitionBy(ENTITY).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)) > 0
        return affine_scan(df, {name: moved}, {name: 50.0}).withColumn(name, F.when(known, F.col(name)))

    k = stage(follow(rows, "kdj_rsv", "kdj_k"), "kdj-k")
    both = follow(k, "kdj_k", "kdj_d")
    return both.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))
