"""What may not grow faster than the input: rows and widths moved by the shared steps."""

from pyspark.sql import functions as F

from tidemark.operators import factors, labels, ranking, scaling
from tidemark.plans import testbed
from tidemark.session import MAX_CUTS_KEY, ROWS_PER_BUCKET_KEY, stage

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_line_items_are_moved_before_they_are_summed(spark):
    plan = _plan(testbed.build_cells(spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning") :]
    lines = testbed.table(spark, FOLDER, "lineitem")
    assert testbed.build_cells(spark, FOLDER).agg(F.sum("lines")).first()[0] == lines.count()


def _many(spark, rows):
    """Two groups, one value held by a third of the rows, nulls in key and value, every id unique."""
    number = F.col("id")
    return spark.range(rows).select(
        F.when(number % 101 == 0, None).when(number % 4 == 0, "a").otherwise("b").alias("d"),
        number.cast("string").alias("e"),
        F.when(number % 53 == 0, None).when(number % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("x"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("double").alias("y"),
    )


def _range_sorts(spark, monkeypatch, build):
    """The result of ``build`` with tiny buckets, and the ranges it sorted."""
    calls = []
    by_range = ranking._by_range

    def counted(*args, **kwargs):
        out = by_range(*args, **kwargs)
        calls.append(out.select("_range").distinct().count())
        return out

    with monkeypatch.context() as patch:
        patch.setattr(ranking, "_by_range", counted)
        spark.conf.set(ROWS_PER_BUCKET_KEY, "16")
        spark.conf.set(MAX_CUTS_KEY, "8")
        try:
            return build().toPandas(), calls
        finally:
            spark.conf.unset(ROWS_PER_BUCKET_KEY)
            spark.conf.unset(MAX_CUTS_KEY)


def test_many_buckets_are_one_range_sort_per_value(spark, monkeypatch):
    df = _many(spark, 4000)
    got, calls = _range_sorts(spark, monkeypatch, lambda: ranking.with_ranks(df, ["d"], ["x", "y"], ["e"]))
    assert len(calls) == 2 and min(calls) > 4  # the frequent value's copies lie in several ranges
    pdf = got.set_index("e").sort_index()
    assert len(pdf) == 4000
    group = pdf.groupby("d")
    for v in ("x", "y"):
        known = pdf["d"].notna() & pdf[v].notna()
        low, high = group[v].rank(method="min"), group[v].rank(method="max")
        assert (pdf[f"{v}__lt"][known] == low[known] - 1).all() and (pdf[f"{v}__eq"][known] == (high - low + 1)[known]).all()
        assert (pdf[f"{v}__n"][known] == group[v].transform("count")[known]).all()
        assert pdf.loc[~known, [f"{v}__lt", f"{v}__eq", f"{v}__n"]].isna().all().all()


def test_many_buckets_place_rows_and_find_quantiles(spark, monkeypatch):
    df = _many(spark, 4000).where("x IS NOT NULL")
    got, calls = _range_sorts(spark, monkeypatch, lambda: ranking.with_position(df, ["d"], ["x", "e"], ["e"]))
    assert len(calls) == 1
    pdf = got.sort_values(["x", "e"])
    known = pdf[pdf["d"].notna()]
    group = known.groupby("d")
    assert (known["position"] == group.cumcount() + 1).all() and (known["group_rows"] == group["x"].transform("size")).all()
    assert (known["group_min"] == group["x"].transform("min")).all() and (known["group_max"] == group["x"].transform("max")).all()
    assert len(pdf) == df.count() and pdf[pdf["d"].isna()]["position"].isna().all()

    probabilities = {"low": 0.01, "third": 1 / 3, "half": 0.5, "top": 1.0}
    found, calls = _range_sorts(spark, monkeypatch, lambda: ranking.group_quantiles(df, ["d"], "x", probabilities, ["e"]))
    assert len(calls) == 1
    for name, p in probabilities.items():
        want = group["x"].quantile(p)
        assert (abs(found.set_index("d")[name].sort_index() - want) < 1e-9).all()


def _moved(spark, build, what="shuffleWriteRecords"):
    """Records (or bytes) written to shuffles while ``build`` runs."""

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(getattr(stages.apply(k), what)() for k in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    build()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_correlation_moves_a_value_twice_whatever_the_row_sets(spark):
    number, names = F.col("id"), [f"f{k}" for k in range(8)]
    # every feature lacks other rows, so each of the 28 pairs has its own complete rows
    values = [F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)) > 0, F.pmod(F.xxhash64("id", F.lit(k + 100)), F.lit(500)).cast("double")).alias(f) for k, f in enumerate(names)]
    df = stage(spark.range(4000).select(F.lit("20200101").alias("trade_date"), number.cast("string").alias("ts_code"), *values), "wide-rows")
    moved = _moved(spark, lambda: factors.correlation_pairs(df, names, None).collect())
    assert moved < 3 * 4000 * len(names)


def test_whole_groups_are_moved_without_joins(spark):
    df = _many(spark, 4000)
    plan = _plan(ranking.with_ranks(df, ["d"], ["x", "y"], ["e"]))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    known = df.where("x IS NOT NULL")
    assert "Join" not in _plan(ranking.with_position(known, ["d"], ["x", "e"], ["e"]))
    assert "Join" not in _plan(ranking.group_quantiles(known, ["d"], "x", {"half": 0.5}, ["e"]))


def test_cells_are_moved_once_for_their_histories(spark):
    assert _plan(testbed.build_wide(spark, FOLDER)).count("Exchange hashpartitioning") == 1


def test_scaling_stores_wide_values(spark, monkeypatch):
    rows, write = {}, scaling.stage

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(scaling, "stage", counted)
    values = [F.col("id").cast("double").alias(f) for f in ("a", "b", "c")]
    df = spark.range(500).select(F.lit("20200101").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), *values)
    assert scaling.cross_section_z(df, ["a", "b", "c"]).count() == 1500
    assert max(rows.values()) == 500


def test_lookahead_moves_a_row_once(spark):
    df = stage(spark.range(3000).select(F.lit("20200101").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), F.rand(1).alias("f")), "panel-rows")
    moved = _moved(spark, lambda: labels.lookahead_rows(lambda p: p, df, "20200101").collect())
    assert moved < 2.5 * 3000


def test_suppliers_with_long_keys_keep_their_own_codes(spark, tmp_path):
    far = {"supplier": "s_suppkey", "lineitem": "l_suppkey"}
    for name in ("supplier", "lineitem", "orders", "nation", "region"):
        rows = testbed.table(spark, FOLDER, name)
        if name in far:  # a copy of every supplier, the copies' keys have six digits
            rows = rows.unionByName(rows.withColumn(far[name], F.col(far[name]) + 123450))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    months = testbed.table(spark, str(tmp_path), "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyyMM")).distinct().count()
    panel = testbed.panel(spark, str(tmp_path))
    assert panel.count() == panel.select("trade_date", "ts_code").distinct().count() == months
    assert testbed.tradable_panel(spark, str(tmp_path)).count() == 2 * testbed.tradable_panel(spark, FOLDER).count()


def test_correlation_moves_values_in_arrays(spark):
    names = [f"f{k}" for k in range(8)]
    values = [F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)) > 0, F.xxhash64("id", F.lit(k)).cast("double")).alias(f) for k, f in enumerate(names)]
    df = stage(spark.range(4000).select(F.lit("20200101").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), *values), "wide-rows")
    moved = _moved(spark, lambda: factors.correlation_pairs(df, names, None).collect())
    assert moved < 4000  # not even once a row, let alone a value


def test_ranks_in_many_row_sets_are_moved_as_small_steps(spark):
    names = [f"f{k}" for k in range(16)]
    # each of the 120 pairs has its own complete rows, so a value has 15 ranks
    values = [F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)) > 0, F.xxhash64("id", F.lit(k + 100)).cast("double")).alias(f) for k, f in enumerate(names)]
    df = stage(spark.range(8000).select(F.lit("20200101").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), *values), "wide-rows")
    moved = _moved(spark, lambda: factors.correlation_pairs(df, names, None).collect(), "shuffleWriteBytes")
    assert moved < 45 * 8000 * 16
