"""Exact ranks, positions and quantiles inside groups of any size.

A plain window over a date would sort the whole cross-section in one task. Here each group is cut into
value buckets first:

1. a fixed hash picks about 32 rows per ``rows_per_bucket`` rows; their sorted values, thinned to every
   32nd, are the group's cut points (a group below that size has none, hence one bucket). A group's sample is
   thinned by a second hash so that its cut points stay within ``max_cuts``; a bucket that is still too
   large is then cut again in the same way, and so on, so buckets are bounded whatever the group's size;
2. rows are counted per bucket, which gives every bucket its offset in the group;
3. only inside a bucket are rows sorted; offset + local rank is the exact group rank.

A value so frequent that it becomes a cut point owns a bucket of its own. All its rows share one rank,
known from the counts, so they are spread over as many tasks as their number asks for, like null rows.
The cut points depend on the data alone, so recomputed tasks agree with the first run.

Cutting level by level reads all rows once more per level. Where a group needs more buckets than one level of cut
points gives, the rows are range-partitioned by group and value instead and sorted once: ranges may split a group
and even the copies of a value; each task places its rows inside its range, and the counts per range, one row for
each group and range, give the offsets. Its cost does not depend on the number of buckets.

Cut points and bucket counts are stored while a plan is built, so these functions run small jobs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from tidemark.functions.scalars import ColumnOrName, sdiv
from tidemark.session import max_cuts, rows_per_bucket, stage

_SAMPLES_PER_BUCKET = 32
_ROWS_PER_RANGE = 1_000_000  # a task of a range sort holds its range


@dataclass
class Layout:
    """How the rows of each group are dealt: cut points by group, finer cut points by bucket, bucket offsets."""

    cuts: DataFrame | None
    finer: list[tuple[str, DataFrame]]
    offsets: dict[str, DataFrame]
    extremes: DataFrame | None

    @property
    def cut(self) -> bool:
        return self.cuts is not None


def _cut_points(sampled: DataFrame, keys: Sequence[str], name: str, ids: Sequence[str]) -> DataFrame:
    """Every 32nd value of each group's sample, after thinning samples that would give too many."""
    limit = _SAMPLES_PER_BUCKET * max_cuts(sampled.sparkSession)
    known = sampled.where(F.col(f"_v_{name}").isNotNull())
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    thin = F.pmod(F.xxhash64(F.lit(1), *ids, f"_v_{name}"), F.ceil(F.col("_n") / F.lit(float(limit)))) == 0
    ordered = known.join(sizes, list(keys)).where(thin).groupBy(*keys).agg(F.sort_array(F.collect_list(f"_v_{name}")).alias("_sample"))
    picked = F.expr(f"array_distinct(filter(_sample, (x, i) -> (i + 1) % {_SAMPLES_PER_BUCKET} = 0))")
    return ordered.select(*keys, picked.alias(f"cuts_{name}"))


def _bucket(value: str, cuts: str) -> Column:
    """Even numbers lie between cut points, odd ones on them, -1 holds nulls. Binary search by halving."""
    below = f"""aggregate(
        array_repeat(0, CAST(ceil(log2(size({cuts}) + 1D)) AS INT)),
        named_struct('low', 0, 'high', size({cuts})),
        (s, _) -> CASE WHEN get({cuts}, (s.low + s.high) DIV 2) < {value}
            THEN named_struct('low', CAST((s.low + s.high) DIV 2 AS INT) + 1, 'high', s.high)
            ELSE named_struct('low', s.low, 'high', CAST((s.low + s.high) DIV 2 AS INT)) END,
        s -> s.low)"""
    return F.expr(
        f"""CASE WHEN {value} IS NULL THEN -1L
            WHEN {cuts} IS NULL OR size({cuts}) = 0 THEN 0L
            ELSE get(transform(array({below}), b -> 2L * b + CASE WHEN coalesce(get({cuts}, b) = {value}, false) THEN 1 ELSE 0 END), 0) END"""
    )


def _with_buckets(df: DataFrame, keys: Sequence[str], names: Sequence[str], cuts: DataFrame | None, finer: list[tuple[str, DataFrame]]) -> DataFrame:
    """``df``, which has the value columns ``_v_*``, with each value's bucket ``_b_*``."""
    if cuts is None:
        return df.withColumns({f"_b_{v}": F.when(F.col(f"_v_{v}").isNull(), -1).otherwise(0).cast("long") for v in names})
    # bucket numbers of one level fit below this; a finer level's number is appended to the coarser one's
    level = 1 << (2 * max_cuts(df.sparkSession) + 2).bit_length()
    out = df.join(cuts, list(keys), "left")
    out = out.withColumns({f"_b_{v}": _bucket(f"_v_{v}", f"cuts_{v}") for v in names}).drop(*[f"cuts_{v}" for v in names])
    for v, table in finer:
        own, inner = F.col(f"_b_{v}"), _bucket(f"_v_{v}", f"cuts_{v}")
        number = F.when(own < 0, own).when(F.col(f"cuts_{v}").isNull(), own * level + own % 2).otherwise(own * level + inner)
        out = out.join(table, [*keys, f"_b_{v}"], "left").withColumn(f"_b_{v}", number).drop(f"cuts_{v}")
    return out


def sampled_rows(df: DataFrame, ids: Sequence[str], limit: int) -> DataFrame:
    """About 32 rows of every ``limit``, the same ones whenever they are taken."""
    return df.where(F.pmod(F.xxhash64(*ids), F.lit(max(1, limit // _SAMPLES_PER_BUCKET))) == 0)


def cut_points(sampled: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str]) -> DataFrame:
    """(keys, cuts): the ascending cut points of each group's ``sampled_rows``, at most ``max_cuts``."""
    rows = stage(sampled.select(*keys, *ids, F.col(value).alias("_v_x")), "rank-sample")
    return _cut_points(rows, keys, "x", ids).select(*keys, F.col("cuts_x").alias("cuts"))


def _bucket_counts(binned: DataFrame, keys: Sequence[str], names: Sequence[str], extremes: bool) -> DataFrame:
    pieces = F.array(*[F.struct(F.lit(v).alias("_which"), F.col(f"_b_{v}").alias("bucket")) for v in names])
    placed = binned.select(*keys, *(["_x"] if extremes else []), F.inline(pieces))
    limits = [F.min("_x").alias("_min"), F.max("_x").alias("_max")] if extremes else []
    return stage(placed.groupBy(*keys, "_which", "bucket").agg(F.count(F.lit(1)).alias("rows"), *limits), "bucket-counts")


def group_layout(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], ids: Sequence[str], extremes: str | None = None
) -> Layout:
    """Cut points and bucket offsets of each value's groups. The tables are stored: their size is then known, so the
    joins with them move only the small side while it is small, and are ordinary (skew-aware) joins beyond that."""
    keys, names, limit = list(keys), list(values), rows_per_bucket(df.sparkSession)
    watched = [F.col(extremes).alias("_x")] if extremes else []
    narrow = df.select(*keys, *ids, *[values[v].alias(f"_v_{v}") for v in names], *watched)
    sampled = stage(sampled_rows(narrow, ids, limit), "rank-sample")
    cuts, finer = None, []
    if not sampled.isEmpty():
        for v in names:
            own = _cut_points(sampled, keys, v, ids)
            cuts = own if cuts is None else cuts.join(own, keys, "full")
        cuts = stage(cuts.where(" OR ".join(f"size(cuts_{v}) > 0" for v in names)), "cuts")
        cuts = None if cuts.isEmpty() else cuts
    binned = _with_buckets(narrow, keys, names, cuts, finer)
    counts = _bucket_counts(binned, keys, names, extremes is not None)
    modulus = max(1, limit // _SAMPLES_PER_BUCKET)
    deepest = 62 // (2 * max_cuts(df.sparkSession) + 2).bit_length() - 1
    while cuts is not None:
        large = counts.where((F.col("bucket") >= 0) & (F.col("bucket") % 2 == 0) & (F.col("rows") > 4 * limit))
        # at most the value names; bucket numbers of more levels would not fit into a long
        wide = [r["_which"] for r in large.select("_which").distinct().collect() if sum(v == r["_which"] for v, _ in finer) < deepest]
        if not wide:
            break
        progress = False
        for v in wide:
            inside = binned.join(large.where(F.col("_which") == v).select(*keys, F.col("bucket").alias(f"_b_{v}")), [*keys, f"_b_{v}"], "left_semi")
            # by value too: rows that share their ids are then sampled apart
            again = inside.where(F.pmod(F.xxhash64(F.lit(len(finer) + 2), *ids, f"_v_{v}"), F.lit(modulus)) == 0)
            cut_again = stage(_cut_points(again, [*keys, f"_b_{v}"], v, ids).where(f"size(cuts_{v}) > 0"), "finer-cuts")
            if not cut_again.isEmpty():
                finer.append((v, cut_again))
                progress = True
        if not progress:  # what is left are copies of a few rows: their bucket is sorted as it is
            break
        binned = _with_buckets(narrow, keys, names, cuts, finer)
        counts = _bucket_counts(binned, keys, names, extremes is not None)
    # one row per bucket of a group: a short window
    group = Window.partitionBy(*keys, "_which")
    live = F.when(F.col("bucket") >= 0, F.col("rows")).otherwise(0)
    before = F.coalesce(F.sum(live).over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*keys, "_which", "bucket", F.struct(before.alias("offset"), F.col("rows")).alias("at"), F.sum(live).over(group).alias("n"))
    placed = stage(placed, "layout")
    offsets = {
        v: placed.where(F.col("_which") == v).select(*keys, F.col("bucket").alias(f"_b_{v}"), F.col("at").alias(f"_at_{v}"), F.col("n").alias(f"n_{v}"))
        for v in names
    }
    ends = counts.groupBy(*keys).agg(F.min("_min").alias("group_min"), F.max("_max").alias("group_max")) if extremes else None
    return Layout(cuts, finer, offsets, stage(ends, "group-ends") if extremes else None)


def _placed(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], ids: Sequence[str], extremes: str | None = None
) -> tuple[DataFrame, bool]:
    """``df`` with, per value, its group's size, its bucket, and the bucket's offset and row count; and
    whether any group was cut."""
    layout = group_layout(df, keys, values, ids, extremes)
    names = list(values)
    out = _with_buckets(df.withColumns({f"_v_{v}": expr for v, expr in values.items()}), keys, names, layout.cuts, layout.finer)
    for v in names:
        out = out.join(layout.offsets[v], [*keys, f"_b_{v}"], "left")
    if layout.extremes is not None:
        out = out.join(layout.extremes, list(keys), "left")
    return out.drop(*[f"_v_{v}" for v in names]), layout.cut


def _part(keys: Sequence[str], v: str, cut: bool) -> list[str]:
    """The columns that place a row for sorting. Uncut groups have one place for all values."""
    return [*keys, f"_b_{v}", f"_s_{v}"] if cut else [*keys, "_s"]


def _spread(df: DataFrame, keys: Sequence[str], v: str, ids: Sequence[str], cut: bool) -> DataFrame:
    """Co-locate each bucket; rows of one repeated value (or null) get as many parts as they need, and
    rows with a null group key, which have no rank, go anywhere. Uncut groups are moved once for all values."""
    homeless = F.lit(False)
    for k in keys:
        homeless = homeless | F.col(k).isNull()
    anywhere = F.xxhash64(*ids)
    if not cut:
        if "_s" in df.columns:
            return df
        return df.withColumn("_s", F.when(homeless, anywhere).otherwise(F.lit(0).cast("long"))).repartition(*keys, "_s")
    limit = rows_per_bucket(df.sparkSession)
    parts = F.when(F.col(f"_b_{v}") % 2 != 0, F.ceil(F.col(f"_at_{v}")["rows"] / F.lit(float(limit)))).otherwise(1)
    salt = F.when(homeless, anywhere).when(parts > 1, F.pmod(anywhere, parts)).otherwise(F.lit(0).cast("long"))
    return df.withColumn(f"_s_{v}", salt).repartition(*_part(keys, v, cut))


def _local_rank(part: Sequence[str], v: str) -> tuple[Column, Column]:
    """Smaller rows and equal rows inside a bucket, from one sort."""
    ordered = Window.partitionBy(*part).orderBy(F.asc_nulls_last(v))
    return F.rank().over(ordered) - 1, F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))


def with_ranks(df: DataFrame, keys: Sequence[str], values: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Add per value column v: ``v__lt`` (smaller values in the group), ``v__eq`` (equal ones, itself
    included) and ``v__n`` (non-null values). ``ids`` tell the rows of a group apart."""
    keys, ids = list(keys), list(ids)
    sizes = _sizes(df, keys)
    rows = _too_large(df, sizes)
    if rows:
        return _ranks_by_range(df, keys, values, ids, rows)
    whole = _whole_groups(df, keys, ids, sizes)
    if whole is not None:
        out, part = whole
        for v in values:
            local, peers = _local_rank(part, v)
            known = F.col(v).isNotNull() & _keyed(keys)
            size = F.count(v).over(Window.partitionBy(*part))
            out = out.withColumns({f"{v}__{name}": F.when(known, c) for name, c in (("lt", local.cast("long")), ("eq", peers), ("n", size))})
        return out.drop("_s")
    exprs = {v: F.col(v) for v in values}
    out, cut = _placed(df, keys, exprs, ids)
    for v in values:
        out = _spread(out, keys, v, ids, cut)
        part = _part(keys, v, cut)
        local, peers = _local_rank(part, v)
        own = F.col(f"_b_{v}") % 2 == 1
        at = F.col(f"_at_{v}")
        known = F.col(v).isNotNull() & at.isNotNull()
        out = out.withColumns({"_local": local, "_peers": peers}).withColumns(
            {
                f"{v}__lt": F.when(known, at["offset"] + F.when(own, 0).otherwise(F.col("_local"))),
                f"{v}__eq": F.when(known, F.when(own, at["rows"]).otherwise(F.col("_peers"))),
                f"{v}__n": F.when(known, F.col(f"n_{v}")),
            }
        ).drop("_local", "_peers", f"_b_{v}", f"_s_{v}", f"_at_{v}", f"n_{v}")
    return out.drop("_s")


def _keyed(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """Rows of the largest group, of all groups, and without a group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    live = F.when(_keyed(keys), F.col("rows"))
    found = sizes.agg(F.max(live).alias("largest"), F.sum(live).alias("all"), F.sum("rows").alias("rows")).first()
    return found["largest"] or 0, found["all"] or 0, (found["rows"] or 0) - (found["all"] or 0)


def _too_large(df: DataFrame, sizes: tuple[int, int, int]) -> int:
    """The number of rows if some group needs more buckets than one level of cut points gives, else 0."""
    return sizes[1] if sizes[0] > rows_per_bucket(df.sparkSession) * max_cuts(df.sparkSession) else 0


def _whole_groups(df: DataFrame, keys: Sequence[str], ids: Sequence[str], sizes: tuple[int, int, int]) -> tuple[DataFrame, list[str]] | None:
    """``df`` with each group in one place, if every group is small enough to be sorted there, and the columns of a place.
    Nothing but the rows is moved; rows with a null key go anywhere."""
    if sizes[0] > rows_per_bucket(df.sparkSession):
        return None
    if not sizes[2]:
        return df.repartition(*keys), list(keys)
    salted = df.withColumn("_s", F.when(_keyed(keys), F.lit(0).cast("long")).otherwise(F.xxhash64(*ids)))
    return salted.repartition(*keys, "_s"), [*keys, "_s"]


def _place_in_range(keys: Sequence[str], value: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A sorted range's rows with the rows of their group before the first equal one, the equal ones, and whether copies
    may lie in a neighbouring range. Without ``value`` no two rows are equal."""

    def changes(column: pa.ChunkedArray) -> np.ndarray:
        """Whether a value differs from the one before; the first does."""
        values = column.combine_chunks()
        a, b = values.slice(0, len(values) - 1), values.slice(1)
        differ = pc.not_equal(a, b).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(values.type):
            differ = differ & ~(np.isnan(a.to_numpy(zero_copy_only=False)) & np.isnan(b.to_numpy(zero_copy_only=False)))
        return np.concatenate([[True], differ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        n = rows.num_rows
        group = np.logical_or.reduce([changes(rows[k]) for k in keys])
        starts = np.flatnonzero(group | changes(rows[value])) if value else np.arange(n)
        sizes = np.diff(np.append(starts, n))
        group_start = np.maximum.accumulate(np.where(group, np.arange(n), 0))[starts]
        edge = np.zeros(len(starts), dtype=bool)
        edge[[0, -1]] = True
        rows = rows.append_column("_lt", pa.array(np.repeat(starts - group_start, sizes)))
        rows = rows.append_column("_eq", pa.array(np.repeat(sizes, sizes)))
        rows = rows.append_column("_edge", pa.array(np.repeat(edge, sizes)))
        rows = rows.append_column("_range", pa.array(np.full(n, TaskContext.get().partitionId(), dtype=np.int32)))
        yield from rows.to_batches()

    return run


def _by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], ids: Sequence[str], rows: int, ties: bool) -> DataFrame:
    """``df``, free of nulls in keys and order, with ``_before`` (smaller rows of the group), ``_equal`` and ``_n`` (all of
    the group); with the group's least and greatest first order column, if rows do not tie."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS_PER_RANGE))
    parts = min(most, -(-rows // rows_per_bucket(spark)))
    dealt = df.repartitionByRange(parts, *keys, *order, F.xxhash64(*ids)).sortWithinPartitions(*keys, *order)
    added = [StructField("_lt", LongType()), StructField("_eq", LongType()), StructField("_edge", BooleanType()), StructField("_range", IntegerType())]
    placer = _place_in_range(keys, order[0] if ties else None)
    # stored, because a range's bounds are sampled anew whenever it is computed
    placed = stage(dealt.mapInArrow(placer, StructType([*df.schema.fields, *added])), "ranges")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    limits = [] if ties else [F.min(order[0]).alias("_min"), F.max(order[0]).alias("_max")]
    ends = [] if ties else [F.min("_min").over(group).alias("group_min"), F.max("_max").over(group).alias("group_max")]
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), *limits)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"), F.sum("_rows").over(group).alias("_n"), *ends)
    out = placed.join(stage(offsets, "range-offsets"), [*keys, "_range"])
    if not ties:
        return out.withColumns({"_before": F.col("_offset") + F.col("_lt"), "_equal": F.col("_eq")})
    # copies of a value that lie in several ranges: two values of a range at most
    value = order[0]
    split = placed.where("_edge").groupBy(*keys, value, "_range").agg(F.count(F.lit(1)).alias("_own"))
    same = Window.partitionBy(*keys, value)
    sooner = same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select(*keys, value, "_range", "_own", F.coalesce(F.sum("_own").over(sooner), F.lit(0)).alias("_sooner"), F.sum("_own").over(same).alias("_all"))
    out = out.join(stage(split.where("_all > _own").drop("_own"), "range-ties"), [*keys, value, "_range"], "left")
    return out.withColumns(
        {"_before": F.col("_offset") + F.col("_lt") - F.coalesce("_sooner", F.lit(0)), "_equal": F.coalesce("_all", "_eq")}
    )


def _ranks_by_range(df: DataFrame, keys: Sequence[str], values: Sequence[str], ids: Sequence[str], rows: int) -> DataFrame:
    out = df
    for v in values:
        known = F.col(v).isNotNull() & _keyed(keys)
        names = {"_before": f"{v}__lt", "_equal": f"{v}__eq", "_n": f"{v}__n"}
        ranked = _by_range(out.where(known), keys, [v], ids, rows, ties=True)
        ranked = ranked.select(*out.columns, *[F.col(c).alias(name) for c, name in names.items()])
        other = out.where(~known).select("*", *[F.lit(None).cast("long").alias(name) for name in names.values()])
        out = ranked.unionByName(other)
    return out


def average_rank(v: str) -> Column:
    """1-based rank with ties averaged."""
    return F.col(f"{v}__lt") + (F.col(f"{v}__eq") + 1) / 2.0


def rank_pct(v: str, ascending: bool = True) -> Column:
    """Average rank over the group's non-null count."""
    up = sdiv(average_rank(v), F.col(f"{v}__n"))
    if ascending:
        return up
    down = F.col(f"{v}__n") - F.col(f"{v}__lt") - F.col(f"{v}__eq") + (F.col(f"{v}__eq") + 1) / 2.0
    return sdiv(down, F.col(f"{v}__n"))


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ids: Sequence[str],
    position: str = "position",
    size: str = "group_rows",
) -> DataFrame:
    """Add the 1-based place of each row in its group's order, the group's row count, and the least and
    greatest first order column as ``group_min`` and ``group_max``.

    ``order`` must be unique in the group and free of nulls.
    """
    keys, ids = list(keys), list(ids)
    sizes = _sizes(df, keys)
    rows = _too_large(df, sizes)
    if rows:
        first = df.schema[order[0]].dataType
        sorted_rows = _by_range(df.where(_keyed(keys)), keys, order, ids, rows, ties=False)
        found = sorted_rows.select(
            *df.columns, (F.col("_before") + 1).alias(position), F.col("_n").alias(size), "group_min", "group_max"
        )
        unknown = {position: "long", size: "long", "group_min": first, "group_max": first}
        return found.unionByName(df.where(~_keyed(keys)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in unknown.items()]))
    whole = _whole_groups(df, keys, ids, sizes)
    if whole is not None:
        out, part = whole
        group = Window.partitionBy(*part)
        made = {
            position: F.row_number().over(group.orderBy(*order)).cast("long"),
            size: F.count(F.lit(1)).over(group),
            "group_min": F.min(order[0]).over(group),
            "group_max": F.max(order[0]).over(group),
        }
        return out.withColumns({name: F.when(_keyed(keys), c) for name, c in made.items()}).drop("_s")
    place = {"o": F.struct(*order)}
    placed, cut = _placed(df, keys, place, ids, extremes=order[0])
    out = _spread(placed, keys, "o", ids, cut)
    local = F.row_number().over(Window.partitionBy(*_part(keys, "o", cut)).orderBy(*order))
    return (
        out.withColumn(position, F.col("_at_o.offset") + local)
        .withColumnRenamed("n_o", size)
        .drop("_b_o", "_s_o", "_s", "_at_o")
    )


def _ranked_near(df: DataFrame, keys: Sequence[str], value: str, low: dict[str, Column], ids: Sequence[str]) -> DataFrame:
    """(keys, value, n_q, lt, eq) of the rows in buckets that hold a wanted position."""
    placed, cut = _placed(df, keys, {"q": F.col(value)}, ids)
    at = F.col("_at_q")
    wanted = F.lit(False)
    for place in low.values():
        for index in (place, place + 1):
            wanted = wanted | ((at["offset"] <= index) & (index < at["offset"] + at["rows"]))
    near = _spread(placed.where(wanted), keys, "q", ids, cut)
    part = _part(keys, "q", cut)
    own = F.col("_b_q") % 2 == 1
    local, peers = _local_rank(part, value)
    ranked = near.select(*keys, value, "n_q", at.alias("at"), own.alias("own"), local.alias("local"), peers.alias("peers"))
    return ranked.select(
        *keys,
        value,
        "n_q",
        (F.col("at.offset") + F.when(F.col("own"), 0).otherwise(F.col("local"))).alias("lt"),
        F.when(F.col("own"), F.col("at.rows")).otherwise(F.col("peers")).alias("eq"),
    )


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], ids: Sequence[str]
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: one row per group, one column per probability.

    Only the buckets that hold a wanted position are sorted, but for groups that are sorted by range.
    """
    keys, ids = list(keys), list(ids)
    known = df.where(F.col(value).isNotNull())
    sizes = _sizes(known, keys)
    rows = _too_large(known, sizes)
    whole = None if rows else _whole_groups(known.where(_keyed(keys)).select(*keys, value), keys, ids, (*sizes[:2], 0))
    low = {name: F.floor((F.col("n_q") - 1) * F.lit(p)) for name, p in probabilities.items()}
    if rows:
        narrow = known.where(_keyed(keys)).select(*keys, value, F.pmod(F.xxhash64(*ids), F.lit(1024)).cast("short").alias("_salt"))
        sorted_rows = _by_range(narrow, keys, [value], ["_salt"], rows, ties=True)
        ranked = sorted_rows.select(*keys, value, F.col("_n").alias("n_q"), F.col("_before").alias("lt"), F.col("_equal").alias("eq"))
    elif whole is not None:
        local, peers = _local_rank(keys, value)
        ranked = whole[0].select(*keys, value, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n_q"), local.alias("lt"), peers.alias("eq"))
    else:
        ranked = _ranked_near(known, keys, value, low, ids)

    def at_index(index: Column) -> Column:
        return F.max(F.when((F.col("lt") <= index) & (index < F.col("lt") + F.col("eq")), F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        F.max("n_q").alias("n_q"),
        *[at_index(low[name]).alias(f"_lo_{name}") for name in probabilities],
        *[at_index(low[name] + 1).alias(f"_hi_{name}") for name in probabilities],
    )

    def between(name: str, p: float) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.coalesce(F.col(f"_hi_{name}"), F.col(f"_lo_{name}"))
        share = (F.col("n_q") - 1) * F.lit(p) - low[name]
        return lo + (hi - lo) * share

    return picked.select(*keys, *[between(name, p).alias(name) for name, p in probabilities.items()])
