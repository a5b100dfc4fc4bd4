"""Factor reports: information coefficients, quantile spreads, quality, correlation, neutralisation.

Everything works on long rows (date, entity, feature, x, y), so one plan serves all features, and no step
sorts a whole cross-section in one task.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import finite, sdiv
from tidemark.operators.features import KEYS, LAG_PREFIX
from tidemark.operators.ranking import average_rank, cut_points, group_quantiles, sampled_rows, with_position, with_ranks
from tidemark.session import rows_per_bucket, stage


def lagged_columns(df: DataFrame) -> list[str]:
    """The published features of a table, by prefix."""
    return [c for c in df.columns if c.startswith(LAG_PREFIX)]


def long_rows(df: DataFrame, features: Sequence[str], label: str | None, extra: Sequence[str] = ()) -> DataFrame:
    """(date, entity, extra.., feature, x, y) with non-finite values as null; the label comes as y."""
    y = [finite(label).alias("y")] if label else []
    wide = df.select(*KEYS, *extra, *y, *[finite(f).alias(f) for f in features])
    return wide.unpivot([*KEYS, *extra, *(["y"] if label else [])], list(features), "feature", "x")


# --- information coefficient ------------------------------------------------------------------------


def _pearson(x: Column, y: Column) -> Column:
    """Correlation that is null when one side does not vary."""
    return sdiv(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _daily_ic(long: DataFrame, min_cross_section: int) -> DataFrame:
    pairs = long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*KEYS, "feature", "x", "y")
    ranked = with_ranks(pairs, ["trade_date", "feature"], ["x", "y"], ["ts_code"])
    return (
        ranked.where(F.col("x__n") >= min_cross_section)
        .select("trade_date", "feature", "x", "y", average_rank("x").alias("rx"), average_rank("y").alias("ry"))
        .groupBy("trade_date", "feature")
        .agg(
            _pearson(F.col("x"), F.col("y")).alias("ic"),
            _pearson(F.col("rx"), F.col("ry")).alias("rank_ic"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def daily_ic(df: DataFrame, features: Sequence[str], label: str, min_cross_section: int = 30) -> DataFrame:
    """Pearson and Spearman correlation with the label per (date, feature), over pairwise complete rows of
    dates with at least ``min_cross_section`` of them."""
    return _daily_ic(long_rows(df, features, label), min_cross_section)


def ic_summary(daily: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, t statistic and sign share per feature; an absent feature gets days = 0."""
    by = list(by)

    def t_stat(c: str) -> Column:
        return sdiv(F.avg(c), F.stddev_samp(c)) * F.sqrt(F.count(c))

    stats = daily.groupBy(*by, "feature").agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        t_stat("ic").alias("ic_t_stat"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        t_stat("rank_ic").alias("rank_ic_t_stat"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double"))).alias("positive_rank_ic_ratio"),
        F.count("rank_ic").alias("days"),
        F.avg("n").alias("avg_cross_section"),
    )
    names = [(f,) for f in features]
    wanted = daily.sparkSession.createDataFrame(names, "feature string")  # the configured features
    if by:
        slices = daily.select(*by).distinct()
        wanted = slices.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    joined = wanted.join(stats, [*by, "feature"], "left")
    return joined.withColumn("days", F.coalesce("days", F.lit(0).cast("long")))


def ordered_ic(table: DataFrame) -> DataFrame:
    """Report order: most days first, then the strongest rank IC."""
    return table.orderBy(F.desc("days"), F.desc_nulls_last(F.abs("rank_ic_mean")), "feature")


# --- quantile spreads -------------------------------------------------------------------------------


def quantile_rows(
    df: DataFrame, features: Sequence[str], label: str, quantiles: int, min_cross_section: int, extra: Sequence[str] = ()
) -> DataFrame:
    """(date, feature, y, bucket): equal-count buckets 1..q per date by value, ties in entity order.

    A date counts with at least max(q, min_cross_section) rows and two distinct values.
    """
    rows = long_rows(df, features, label, extra).where(F.col("y").isNotNull() & F.col("x").isNotNull())
    placed = with_position(rows, ["trade_date", "feature"], ["x", "ts_code"], ["ts_code"])
    valid = (F.col("group_rows") >= max(quantiles, min_cross_section)) & (F.col("group_min") != F.col("group_max"))
    bucket = F.floor((F.col("position") - 1) * F.lit(quantiles) / F.col("group_rows")) + 1
    return placed.where(valid).select(*KEYS, *extra, "feature", "y", F.least(bucket, F.lit(quantiles)).cast("int").alias("bucket"))


def _spread_summary(daily: DataFrame, quantiles: int, by: Sequence[str]) -> DataFrame:
    """``daily``: per (by.., feature, date) the mean label of bottom and top bucket."""
    group = [*by, "feature"]
    # one row per date: a window over a feature's dates is bounded by the calendar
    over_dates = Window.partitionBy(*group).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("ls", F.col("top") - F.col("bottom")).withColumn(
        "wealth", F.product(1 + F.coalesce("ls", F.lit(0.0))).over(over_dates)
    )
    drawdown = curve.withColumn("drawdown", sdiv("wealth", F.max("wealth").over(over_dates)) - 1)
    days = F.count("ls")
    some = days > 0
    return drawdown.groupBy(*group).agg(
        F.lit(quantiles).alias("quantiles"),
        F.avg("bottom").alias("q1_mean_return"),
        F.avg("top").alias("q_top_mean_return"),
        F.avg("ls").alias("long_short_mean_return"),
        (sdiv(F.avg("ls"), F.stddev_samp("ls")) * F.sqrt(days)).alias("long_short_t_stat"),
        F.when(some, F.avg(F.coalesce((F.col("ls") > 0).cast("double"), F.lit(0.0)))).alias("long_short_win_ratio"),
        F.when(some, F.min("drawdown")).alias("long_short_max_drawdown"),
        days.alias("days"),
    )


def _bucket_days(rows: DataFrame, quantiles: int, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "feature", "trade_date").agg(
        F.avg(F.when(F.col("bucket") == 1, F.col("y"))).alias("bottom"),
        F.avg(F.when(F.col("bucket") == quantiles, F.col("y"))).alias("top"),
    )


def quantile_spread(
    df: DataFrame, features: Sequence[str], label: str, quantiles: int = 5, min_cross_section: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """Long-short statistics per feature, and per slice when ``by`` names date-level columns of ``df``
    (buckets are formed per date, so slicing does not change them)."""
    rows = quantile_rows(df, features, label, quantiles, min_cross_section, by)
    return _spread_summary(_bucket_days(rows, quantiles, by), quantiles, by)


def yearly_quantile_spread(
    df: DataFrame, features: Sequence[str], label: str, quantiles: int = 5, min_cross_section: int = 30
) -> DataFrame:
    dated = df.withColumn("year", F.substring("trade_date", 1, 4))
    return quantile_spread(dated, features, label, quantiles, min_cross_section, ["year"])


def ordered_spread(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("days"), F.desc_nulls_last(F.abs("long_short_mean_return")), "feature")


def quantile_detail(
    df: DataFrame, features: Sequence[str], label: str, quantiles: int = 5, min_cross_section: int = 30
) -> DataFrame:
    """Pooled mean label per bucket and whether the means rise or fall through all buckets."""
    rows = quantile_rows(df, features, label, quantiles, min_cross_section)
    means = rows.groupBy("feature", "bucket").agg(F.avg("y").alias("mean_return"))
    # one row per bucket
    ladder = Window.partitionBy("feature").orderBy("bucket")
    whole = Window.partitionBy("feature")
    step = F.col("mean_return") - F.lag("mean_return").over(ladder)
    stepped = means.withColumn("step", step)
    full = F.count(F.lit(1)).over(whole) == quantiles
    up = full & F.bool_and(F.coalesce(F.col("step") >= 0, F.lit(True))).over(whole)
    down = full & F.bool_and(F.coalesce(F.col("step") <= 0, F.lit(True))).over(whole)
    return stepped.select(
        "feature",
        F.col("bucket").alias("quantile"),
        "mean_return",
        (up | down).alias("is_monotonic"),
        F.when(up, "up").when(down, "down").otherwise("none").alias("monotonic_direction"),
    )


# --- neutralisation ---------------------------------------------------------------------------------

# Exposures and features that are not neutralised.
SIZE_EXPOSURE = "lag1_log_circ_mv"
LIQUIDITY_CANDIDATES = ["lag1_turnover_rate_f", "lag1_turnover_rate", "lag1_turnover_5d_mean", "lag1_turnover_60d_mean"]
NOT_NEUTRALIZED = ["lag1_log_circ_mv", "lag1_turnover_rate", "lag1_turnover_rate_f"]
NEUTRAL_SUFFIX = "__neutral"
_SINGULAR = 1e-12
_RESIDUAL_GRAIN = 1e-10


def neutral_rows(df: DataFrame, features: Sequence[str], label: str | None) -> DataFrame:
    """Long rows whose x is the residual of a per-date least-squares fit of the feature on a constant, size
    and liquidity. Null where a row lacks an input or the date has too few (<= 4) or constant values.

    Means, variances and covariances per (date, feature) give the fit in closed form; they merge on the
    map side and are stable because they are centred.
    """
    size = finite(SIZE_EXPOSURE) if SIZE_EXPOSURE in df.columns else F.lit(None).cast("double")
    found = next((c for c in LIQUIDITY_CANDIDATES if c in df.columns), None)
    liquidity = finite(found) if found else F.lit(None).cast("double")
    exposed = df.withColumns({"_size": size, "_liq": liquidity})
    names = [f for f in features if f not in NOT_NEUTRALIZED]
    rows = long_rows(exposed, names, label, ["_size", "_liq"])
    usable = F.col("_size").isNotNull() & F.col("_liq").isNotNull() & F.col("x").isNotNull()
    a, b, v = F.col("_size"), F.col("_liq"), F.col("x")
    moments = (
        rows.where(usable)
        .groupBy("trade_date", "feature")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            (F.min(v) != F.max(v)).alias("_varies"),
            F.avg(a).alias("_ma"),
            F.avg(b).alias("_mb"),
            F.avg(v).alias("_mv"),
            F.stddev_pop(v).alias("_sd"),
            F.var_pop(a).alias("_vaa"),
            F.var_pop(b).alias("_vbb"),
            F.covar_pop(a, b).alias("_vab"),
            F.covar_pop(a, v).alias("_vav"),
            F.covar_pop(b, v).alias("_vbv"),
        )
        .where((F.col("_n") > 4) & F.col("_varies"))
    )
    det = F.col("_vaa") * F.col("_vbb") - F.col("_vab") * F.col("_vab")
    regular = det > F.lit(_SINGULAR) * F.col("_vaa") * F.col("_vbb")
    # with dependent exposures the fit spans one of them: use the one that varies more
    on_a = F.col("_vaa") >= F.col("_vbb")
    slope_a = F.when(regular, sdiv(F.col("_vav") * F.col("_vbb") - F.col("_vbv") * F.col("_vab"), det)).otherwise(
        F.when(on_a, F.coalesce(sdiv("_vav", "_vaa"), F.lit(0.0))).otherwise(F.lit(0.0))
    )
    slope_b = F.when(regular, sdiv(F.col("_vbv") * F.col("_vaa") - F.col("_vav") * F.col("_vab"), det)).otherwise(
        F.when(on_a, F.lit(0.0)).otherwise(F.coalesce(sdiv("_vbv", "_vbb"), F.lit(0.0)))
    )
    fits = moments.select("trade_date", "feature", "_ma", "_mb", "_mv", "_sd", slope_a.alias("_sa"), slope_b.alias("_sb"))
    # stored, so the join knows its size and need not move the rows by date
    fitted = rows.join(stage(fits, "fits"), ["trade_date", "feature"], "left")
    residual = (v - F.col("_mv")) - F.col("_sa") * (a - F.col("_ma")) - F.col("_sb") * (b - F.col("_mb"))
    # equal residuals must tie in ranks whatever the order of the sums above
    grain = F.col("_sd") * F.lit(_RESIDUAL_GRAIN)
    residual = F.when(residual.isNotNull(), F.coalesce(F.round(sdiv(residual, grain)) * grain, F.lit(0.0)))
    return fitted.select(
        *KEYS, *(["y"] if label else []), F.concat("feature", F.lit(NEUTRAL_SUFFIX)).alias("feature"), residual.alias("x")
    )


def neutral_ic_summary(df: DataFrame, features: Sequence[str], label: str, min_cross_section: int = 30) -> DataFrame:
    names = [f"{f}{NEUTRAL_SUFFIX}" for f in features if f not in NOT_NEUTRALIZED]
    # the residuals are ranked in three passes, so they are computed once
    rows = stage(neutral_rows(df, features, label), "neutral")
    return ic_summary(_daily_ic(rows, min_cross_section), names)


# --- quality ----------------------------------------------------------------------------------------


def quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing, finite and zero shares, moments, quantiles and distinct values per feature."""
    rows = long_rows(df, features, None)
    x = F.col("x")
    # distinct values first: repeated values merge on the map side and no task holds a feature's value set
    values = rows.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    counts = values.groupBy("feature").agg(
        F.sum("c").alias("_all"),
        F.sum(F.when(x.isNotNull(), F.col("c"))).alias("_known"),
        F.sum(F.when(x == 0, F.col("c"))).alias("_zero"),
        F.count("x").alias("unique_values"),
    )
    moments = rows.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    spots = group_quantiles(rows, ["feature"], "x", {"p01": 0.01, "p50": 0.50, "p99": 0.99}, KEYS)
    known, zero = F.coalesce("_known", F.lit(0)), F.coalesce("_zero", F.lit(0))
    return (
        counts.join(moments, "feature")
        .join(spots, "feature", "left")
        .select(
            "feature",
            (1 - known / F.col("_all")).alias("missing_ratio"),
            (known / F.col("_all")).alias("finite_ratio"),
            (zero / F.col("_all")).alias("zero_ratio"),
            "mean",
            "std",
            "min",
            "p01",
            "p50",
            "p99",
            "max",
            "unique_values",
        )
    )


# --- correlation between features -------------------------------------------------------------------


def _mask_products(n: int):
    """(i, j, rows): how many rows know both features, summed over a task's patterns (known, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            known = np.asarray(batch.column(0).flatten()).reshape(-1, n).astype(float)
            total += known.T @ (known * batch.column(1).to_numpy()[:, None])
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "rows"])

    return run


def _shared_counts(df: DataFrame, features: Sequence[str]) -> dict[tuple[str, str], int]:
    """Rows where both features are known, for every pair (and each feature with itself).

    Rows are counted per pattern of known features first, which leaves few rows for the products. The
    result has one number per pair of configured features.
    """
    patterns = df.groupBy(F.array(*[finite(f).isNotNull() for f in features]).alias("known")).agg(F.count(F.lit(1)).alias("rows"))
    summed = patterns.mapInArrow(_mask_products(len(features)), "i long, j long, rows long").groupBy("i", "j").agg(F.sum("rows").alias("rows"))
    found = {(r["i"], r["j"]): r["rows"] for r in summed.collect()}
    return {(a, features[j]): found.get((i, j), 0) for i, a in enumerate(features) for j in range(i, len(features))}


def _row_sets(features: Sequence[str], shared: dict[tuple[str, str], int]) -> dict[tuple[str, str], tuple[str, ...]]:
    """For each pair the smallest known name of its set of complete rows.

    Features known on the same rows form a class; when one class's rows contain the other's, the pair's
    rows are those of the smaller class. Counts decide both exactly.
    """
    count = lambda a, b: shared[(a, b)] if (a, b) in shared else shared[(b, a)]
    head: dict[str, str] = {}
    for f in features:
        same = next((g for g in head.values() if count(f, g) == count(f, f) == count(g, g)), f)
        head[f] = same
    out = {}
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            p, q = head[a], head[b]
            both = count(p, q)
            if both == count(p, p):
                out[(a, b)] = (p,)
            elif both == count(q, q):
                out[(a, b)] = (q,)
            else:
                out[(a, b)] = tuple(sorted((p, q)))
    return out


_MASK_BITS = 60
_ROWS_PER_SORT = 250_000  # a task holds a bucket's ranks in all row sets of its feature
_ROWS_PER_PRODUCT = 8_192  # a task holds the ranks of all features of so many rows; their places fit into 16 bits


@dataclass(frozen=True)
class RowSets:
    """``of``: per feature the numbers of the row sets it is ranked in; ``needs``: per row set the bits a row's mask must have;
    ``sizes``: rows of each row set; ``pairs``: per row set the feature places (i <= j) whose products are wanted."""

    of: list[list[int]]
    needs: list[list[int]]
    sizes: list[int]
    pairs: list[list[tuple[int, int]]]


def _membership(needs: Sequence[Sequence[int]]):
    """Whether rows with the given masks lie in a row set. What tasks run is closed over plain lists, as workers need not have this package."""

    def member(masks: Sequence[np.ndarray], number: int) -> np.ndarray:
        found = np.ones(len(masks[0]), dtype=bool)
        for bit in needs[number]:
            found &= (masks[bit // _MASK_BITS] >> (bit % _MASK_BITS)) & 1 == 1
        return found

    return member


def _binning(cuts: dict[int, list[float]]):
    """The bucket of values of a feature: even ones lie between its cut points, odd ones on them."""
    points = {f: np.unique(np.asarray(c)) for f, c in cuts.items()}
    none = np.empty(0)

    def bucket(f: int, x: np.ndarray) -> np.ndarray:
        own = points.get(f, none)
        if not len(own):
            return np.zeros(len(x), dtype=np.int64)
        below = np.searchsorted(own, x)
        return 2 * below + (own[np.minimum(below, len(own) - 1)] == x)

    return bucket


def _set_counts(sets: RowSets, used: Sequence[int], cuts: dict[int, list[float]], words: int):
    """(feature, bucket, place, rows): rows of a bucket in each row set of its feature, and all of them at place -1, summed over a task's rows."""
    of, used, member, bucket_of = sets.of, list(used), _membership(sets.needs), _binning(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            masks = [batch.column(k).to_numpy() for k in range(words)]
            inside = {number: member(masks, number) for number in {n for f in used for n in of[f]}}
            for k, f in enumerate(used):
                x = batch.column(words + 1 + k).to_numpy(zero_copy_only=False)
                known = ~np.isnan(x)
                bucket = bucket_of(f, x[known])
                size = 2 * len(cuts.get(f, ())) + 1
                counted = [np.bincount(bucket, minlength=size), *[np.bincount(bucket[inside[number][known]], minlength=size) for number in of[f]]]
                total[f] = total.get(f, 0) + np.stack(counted)
        for f, counted in total.items():
            held = np.flatnonzero(counted[0])
            places, n = len(counted), len(held)
            columns = [np.full(n * places, f, dtype=np.int32), np.tile(held, places), np.repeat(np.arange(-1, places - 1, dtype=np.int32), n), counted[:, held].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "_b_x", "place", "rows"])

    return run


def _dealt_values(sets: RowSets, used: Sequence[int], cuts: dict[int, list[float]], masks: Sequence[str], most: int):
    """(feature, bucket, chunk, seal, at, x, masks..): a chunk is up to ``most`` rows that lie together; of each of its features a row for each bucket, with the
    places in the chunk, values and masks of all its rows there, by ascending value. The seal tells whether a chunk that is read again holds the same rows."""
    used, masks, bucket_of = list(used), list(masks), _binning(cuts)
    words = len(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                rows = batch.slice(begin, most)
                bits = [rows.column(k).to_numpy() for k in range(words)]
                seal = zlib.crc32(rows.column(words).to_numpy().tobytes())
                features, buckets, sizes, ats, values = [], [], [], [], []
                for k, f in enumerate(used):
                    x = rows.column(words + 1 + k).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(~np.isnan(x))
                    at = at[np.argsort(x[at], kind="stable")]
                    found, rows_in = np.unique(bucket_of(f, x[at]), return_counts=True)
                    features.append(np.full(len(found), f, dtype=np.int32))
                    buckets.append(found)
                    sizes.append(rows_in)
                    ats.append(at)
                    values.append(x[at])
                at, n = np.concatenate(ats), sum(len(b) for b in buckets)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int16), np.concatenate(values), *[b[at] for b in bits])]
                plain = [np.concatenate(features), np.concatenate(buckets), np.full(n, chunk), np.full(n, seal)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in plain], *lists], ["feature", "_b_x", "chunk", "seal", "at", "x", *masks])
                chunk += 1

    return run


def _set_ranks(sets: RowSets, masks: Sequence[str], size: int):
    """A bucket's rows with their ranks in each row set of the feature: twice the average rank less its mean.

    Ranks of a chunk's rows ascend, and grow alike in all sets. So ``first`` holds the ranks of the first row, and for the others ``b0..`` the bytes, lowest first, of the steps in the
    largest set and of what the other sets' steps lack: small numbers, whose upper bytes are all equal and take no room once compressed.
    """
    of, set_rows, masks, member = sets.of, sets.sizes, list(masks), _membership(sets.needs)

    def run(key: tuple, rows: pa.Table, at: pa.Table) -> pa.Table:
        f, bucket = key[0].as_py(), key[1].as_py()
        numbers = of[f]
        kept = [rows[c] for c in ("chunk", "seal", "feature", "at")]
        names = ["chunk", "seal", "feature", "at", "first", *[f"b{k}" for k in range(size)]]
        if not rows.num_rows:
            empty = [pa.array([], pa.list_(pa.int64())), *[pa.array([], pa.binary())] * size]
            return pa.table([*kept, *empty], names=names)
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
        x, n = flat("x"), rows.num_rows
        ends = np.concatenate([[0], np.cumsum(rows["x"].combine_chunks().value_lengths().to_numpy())])
        before = {p["place"]: p for p in at["at"][0].as_py()}
        ranks = np.empty((len(x), len(numbers)), dtype=np.int64)
        if bucket % 2:  # copies of one value, of which these may be a part
            for place, number in enumerate(numbers):
                ranks[:, place] = 2 * before[place]["offset"] + before[place]["rows"] - set_rows[number]
        else:
            bits = [flat(m) for m in masks]
            order = np.argsort(x, kind="stable")
            ordered = x[order]
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            copies = np.diff(np.append(starts, len(x)))
            for place, number in enumerate(numbers):
                seen = np.concatenate([[0], np.cumsum(member(bits, number)[order])])
                ranks[order, place] = np.repeat(2 * before[place]["offset"] + seen[starts] + seen[starts + copies] - set_rows[number], copies)
        first = ranks[ends[:-1]]
        steps = np.diff(ranks, axis=0, prepend=ranks[:1])
        steps[ends[:-1]] = 0
        most = max(range(len(numbers)), key=lambda k: set_rows[numbers[k]])
        lacks = steps[:, [most]] - steps
        lacks[:, most] = steps[:, most]
        planes = lacks.astype(f"<i{size}").view(np.uint8).reshape(len(x), len(numbers), size)
        offsets = pa.py_buffer((ends * len(numbers)).astype(np.int32))
        blobs = [pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(planes[:, :, k]))]) for k in range(size)]
        firsts = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(numbers), pa.array(first.ravel()))
        return pa.table([*kept, firsts, *blobs], names=names)

    return run


def _rank_products(sets: RowSets, heads: Sequence[int], size: int):
    """(row_set, i, j, product) summed over a chunk's rows, each given with all its features. ``heads``: the feature of each bit of a mask."""
    of, pairs_of, needs, heads, set_rows = sets.of, sets.pairs, sets.needs, list(heads), sets.sizes
    members = [sorted({i for pair in pairs for i in pair}) for pairs in pairs_of]
    start = [0, *np.cumsum([len(m) for m in members]).tolist()]
    column = [[start[number] + members[number].index(f) for number in numbers] for f, numbers in enumerate(of)]
    inner = [np.array([[m.index(i), m.index(j)] for i, j in pairs]).T for m, pairs in zip(members, pairs_of, strict=True)]
    named = [np.array([p[side] for pairs in pairs_of for p in pairs], dtype=np.int64) for side in (0, 1)]
    row_set = np.repeat(np.arange(len(pairs_of), dtype=np.int32), [len(p) for p in pairs_of])

    def run(rows: pa.Table) -> pa.Table:
        if len(rows["seal"].unique()) > 1:
            raise ValueError("the rows came in another order when they were read again: store the table first")
        at, firsts = rows["at"].combine_chunks(), rows["first"].combine_chunks()
        blobs = [rows[f"b{k}"].combine_chunks() for k in range(size)]
        height = int(at.flatten().to_numpy().max()) + 1
        dense = np.zeros((height, start[-1]))
        known: dict[int, np.ndarray] = {}
        feature = rows["feature"].to_numpy()
        for f in np.unique(feature):
            own, sets_of = pa.array(np.flatnonzero(feature == f)), len(of[f])
            held = at.take(own)
            places = held.flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())[:-1]])
            planes = [np.frombuffer(b.take(own).buffers()[2], np.uint8, len(places) * sets_of) for b in blobs]
            lacks = np.stack(planes, axis=-1).view(f"<i{size}").reshape(len(places), sets_of).astype(np.int64)
            most = max(range(sets_of), key=lambda k: set_rows[of[f][k]])
            steps = lacks[:, [most]] - lacks
            steps[:, most] = lacks[:, most]
            steps[begin] = firsts.take(own).flatten().to_numpy().reshape(-1, sets_of)
            steps[begin[1:]] -= np.add.reduceat(steps, begin, axis=0)[:-1]
            dense[places[:, None], column[f]] = np.cumsum(steps, axis=0)
            if f in heads:
                known[f] = np.zeros(height, dtype=bool)
                known[f][places] = True
        out = []
        for number, (i, j) in enumerate(inner):
            inside = np.ones(height, dtype=bool)
            for bit in needs[number]:
                inside &= known.get(heads[bit], False)
            part = dense[inside, start[number] : start[number + 1]]
            out.append((part.T @ part)[i, j])
        return pa.table([pa.array(row_set), *[pa.array(c) for c in named], pa.array(np.concatenate(out))], names=["row_set", "i", "j", "product"])

    return run


def _rank_sums(df: DataFrame, features: Sequence[str], heads: Sequence[str], sets: RowSets, total: int) -> DataFrame:
    """(row_set, i, j, product): sums of products of centred ranks, in quarters."""
    spark = df.sparkSession
    used = [i for i, numbers in enumerate(sets.of) if numbers]
    words = [heads[k : k + _MASK_BITS] for k in range(0, len(heads), _MASK_BITS)]
    masks = [f"_m{k}" for k in range(len(words))]
    bits = [functools.reduce(lambda a, b: a + b, [F.when(finite(h).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, h in enumerate(w)]) for w in words]
    rows = df.select(*[b.alias(m) for b, m in zip(bits, masks, strict=True)], F.xxhash64(*KEYS).alias("_id"), *[finite(features[i]).alias(f"_x{i}") for i in used])

    limit = min(rows_per_bucket(spark), _ROWS_PER_SORT)
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), finite(features[i]).alias("x")) for i in used])
    sampled = sampled_rows(df, KEYS, limit).select(*KEYS, F.inline(cells))
    # at most max_cuts numbers a feature
    cuts = {r["feature"]: r["cuts"] for r in cut_points(sampled, ["feature"], "x", KEYS).collect()}
    counts = rows.mapInArrow(_set_counts(sets, used, cuts, len(words)), "feature int, _b_x long, place int, rows long")
    counts = stage(counts.groupBy("feature", "_b_x", "place").agg(F.sum("rows").alias("rows")), "set-counts")
    # one row per bucket, feature and row set
    earlier = Window.partitionBy("feature", "place").orderBy("_b_x").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("place", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"), "rows")
    placed = counts.select("feature", "_b_x", at.alias("at")).groupBy("feature", "_b_x").agg(F.collect_list("at").alias("at"))
    # copies of a frequent value need no sort: as many parts as they ask for
    sizes = counts.where("place = -1 AND _b_x % 2 = 1").select("feature", "_b_x", F.ceil(F.col("rows") / F.lit(float(limit))).alias("_parts"))
    split = stage(sizes.where("_parts > 1"), "set-parts")
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("chunk"), F.col("_parts")))
    lists = ", ".join(["at array<short>", "x array<double>", *[f"{m} array<long>" for m in masks]])
    dealt = rows.mapInArrow(_dealt_values(sets, used, cuts, masks, _ROWS_PER_PRODUCT), f"feature int, _b_x long, chunk long, seal long, {lists}")
    dealt = dealt.join(split, ["feature", "_b_x"], "left").withColumn("_s", salt.cast("long")).drop("_parts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
    offsets = placed.join(split, ["feature", "_b_x"], "left").select("feature", "_b_x", salts.alias("_s"), "at")

    size = 8 if 2 * total >= 1 << 31 else 4  # bytes of a step
    group = ["feature", "_b_x", "_s"]
    schema = f"chunk long, seal long, feature int, at array<short>, first array<long>, {', '.join(f'b{k} binary' for k in range(size))}"
    ranked = dealt.groupBy(*group).cogroup(offsets.groupBy(*group)).applyInArrow(_set_ranks(sets, masks, size), schema)
    products = ranked.groupBy("chunk").applyInArrow(_rank_products(sets, [features.index(h) for h in heads], size), "row_set int, i long, j long, product double")
    return products.groupBy("row_set", "i", "j").agg(F.sum("product").alias("product"))


def correlation_pairs(df: DataFrame, features: Sequence[str], top_n: int | None = 100, min_shared: int | None = None) -> DataFrame:
    """Spearman correlation of every feature pair over its pairwise complete rows, strongest first.

    Pairs with fewer than ``min_shared`` common rows (by default a hundredth of all rows, 20 at least) have none.
    ``top_n`` is for printed tables; None gives all pairs.

    A feature's values are sorted once, in buckets: its rank within a set of complete rows is a running count of the set's rows, which
    one sort gives for all sets. Each (row, feature) is moved twice, to its bucket and, with its ranks, back to the chunk of rows it came from, together
    with the chunk's others in that bucket; ranks are centred on their known mean, so sums of their products are the covariances. ``df`` should be
    a stored table: a lost task that reads its rows in another order stops the run.
    """
    features = list(features)
    total = df.count()
    need = max(20, total // 100) if min_shared is None else min_shared
    shared = _shared_counts(df, features)
    place = {f: i for i, f in enumerate(features)}
    number: dict[tuple[str, ...], int] = {}
    wanted_pairs: list[list[tuple[int, int]]] = []
    pairs = []
    for (a, b), rows in _row_sets(features, shared).items():
        if shared[(a, b)] >= need:
            k = number.setdefault(rows, len(number))
            if k == len(wanted_pairs):
                wanted_pairs.append([])
            wanted_pairs[k].append((place[a], place[b]))
            pairs.append((a, b, place[a], place[b], k))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "feature_left string, feature_right string, spearman_corr double")
    members = [sorted({i for pair in group for i in pair}) for group in wanted_pairs]
    heads = sorted({h for rows in number for h in rows}, key=place.get)
    bit = {h: k for k, h in enumerate(heads)}
    sets = RowSets(
        of=[[k for k, group in enumerate(members) if i in group] for i in range(len(features))],
        needs=[[bit[h] for h in rows] for rows in number],
        sizes=[shared[min(rows, key=place.get), max(rows, key=place.get)] for rows in number],
        pairs=[[*[(i, i) for i in group], *wanted] for group, wanted in zip(members, wanted_pairs, strict=True)],
    )
    # at most a number for each pair of a row set's features
    sums = stage(_rank_sums(df, features, heads, sets, total), "rank-products")
    own = sums.where("i = j").select("row_set", "i", F.col("product").alias("own"))
    wanted = spark.createDataFrame(pairs, "feature_left string, feature_right string, i long, j long, row_set int")
    joined = wanted.join(sums, ["row_set", "i", "j"], "left").join(own, ["row_set", "i"]).join(own.select("row_set", F.col("i").alias("j"), F.col("own").alias("other")), ["row_set", "j"])
    value = sdiv(F.coalesce("product", F.lit(0.0)), F.sqrt(F.col("own") * F.col("other")))
    found = joined.select("feature_left", "feature_right", value.alias("spearman_corr")).where(F.col("spearman_corr").isNotNull())
    ordered = found.orderBy(F.desc(F.abs("spearman_corr")), "feature_left", "feature_right")
    return ordered.limit(top_n) if top_n is not None else ordered
