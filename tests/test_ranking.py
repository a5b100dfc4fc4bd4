import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking


def skewed_frame():
    rng = np.random.default_rng(3)
    rows = 3000
    group = np.where(rng.random(rows) < 0.6, "hot", rng.choice(["a", "b", "c"], rows))
    value = rng.normal(size=rows).round(2)
    value[rng.random(rows) < 0.35] = 0.0  # one value holds a third of the rows
    pdf = pd.DataFrame({"d": group, "id": [f"e{i:05d}" for i in range(rows)], "x": value})
    pdf.loc[rng.random(rows) < 0.1, "x"] = np.nan
    pdf.loc[rng.random(rows) < 0.02, "d"] = None
    pdf["y"] = rng.normal(size=rows)
    return pdf


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "d string, id string, x double, y double")
    return df


@pytest.mark.parametrize("buckets", ["40", "1000000"])
def test_ranks_equal_pandas(spark, buckets):
    spark.conf.set("tidemark.rank.rowsPerBucket", buckets)
    try:
        pdf = skewed_frame()
        df = to_spark(spark, pdf)
        got = (
            ranking.with_ranks(df, ["d"], ["x", "y"], ["id"])
            .select("id", ranking.average_rank("x").alias("r"), ranking.rank_pct("x").alias("p"),
                    ranking.rank_pct("x", ascending=False).alias("q"), ranking.average_rank("y").alias("ry"))
            .toPandas().set_index("id").sort_index()
        )
    finally:
        spark.conf.unset("tidemark.rank.rowsPerBucket")
    pdf = pdf.set_index("id")
    g = pdf.groupby("d")
    assert len(got) == len(pdf)
    for name, want in {"r": g["x"].rank(), "p": g["x"].rank(pct=True), "q": g["x"].rank(pct=True, ascending=False), "ry": g["y"].rank()}.items():
        pd.testing.assert_series_equal(got[name].astype(float), want.sort_index(), check_names=False)


@pytest.mark.parametrize("buckets", ["40", "1000000"])
def test_positions_equal_pandas_first_rank(spark, buckets):
    spark.conf.set("tidemark.rank.rowsPerBucket", buckets)
    try:
        pdf = skewed_frame().dropna()
        got = (
            ranking.with_position(to_spark(spark, pdf), ["d"], ["x", "id"], ["id"])
            .select("id", "position", "group_rows", "group_min", "group_max").toPandas().set_index("id").sort_index()
        )
    finally:
        spark.conf.unset("tidemark.rank.rowsPerBucket")
    pdf = pdf.sort_values("id").set_index("id")
    g = pdf.groupby("d")["x"]
    assert (got["position"] == g.rank(method="first")).all()
    assert (got["group_rows"] == g.transform("size")).all()
    assert (got["group_min"] == g.transform("min")).all() and (got["group_max"] == g.transform("max")).all()


@pytest.mark.parametrize("buckets", ["40", "1000000"])
def test_quantiles_equal_pandas(spark, buckets):
    spark.conf.set("tidemark.rank.rowsPerBucket", buckets)
    try:
        pdf = skewed_frame()
        probs = {"p01": 0.01, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p100": 1.0}
        got = (
            ranking.group_quantiles(to_spark(spark, pdf).where(F.col("d").isNotNull()), ["d"], "x", probs, ["id"])
            .toPandas().set_index("d").sort_index()
        )
    finally:
        spark.conf.unset("tidemark.rank.rowsPerBucket")
    for name, p in probs.items():
        want = pdf.groupby("d")["x"].quantile(p)
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_hot_value_is_spread_over_tasks(spark, tiny_buckets):
    df = spark.range(4000).select(F.lit("d").alias("d"), F.col("id").cast("string").alias("id"),
                                  F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("x"))
    placed, cut = ranking._placed(df, ["d"], {"x": F.col("x")}, ["id"])
    assert cut
    placed = ranking._spread(placed, ["d"], "x", ["id"], cut)
    largest = placed.groupBy("_b_x", "_s_x").count().agg(F.max("count")).first()[0]
    assert largest < 400


def test_large_groups_are_cut_again(spark, tiny_buckets):
    spark.conf.set("tidemark.rank.maxCuts", "3")
    try:
        df = spark.range(30000).select(F.lit("d").alias("d"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
        layout = ranking.group_layout(df, ["d"], {"x": F.col("x")}, ["id"])
        assert len(layout.finer) > 1
        sorted_rows = layout.offsets["x"].where("_b_x % 2 = 0").agg(F.max("_at_x.rows"), F.count("*")).first()
        assert sorted_rows[0] <= 160 and sorted_rows[1] > 200
        got = ranking.with_ranks(df, ["d"], ["x"], ["id"]).select("id", ranking.average_rank("x").alias("r")).toPandas().set_index("id")["r"].sort_index()
    finally:
        spark.conf.unset("tidemark.rank.maxCuts")
    values = pd.Series({str(i): 7.0 if i % 5 == 0 else float(i) for i in range(30000)}).sort_index()
    assert (got == values.rank()).all()


def test_plain_groups_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("d"), F.col("id").cast("string").alias("id"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    for out in (
        ranking.with_ranks(df.where("x is not null"), ["d"], ["x", "y"], ["id"]),
        ranking.with_position(df, ["d"], ["x", "id"], ["id"]),
    ):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1


def test_hot_null_key_and_null_values(spark):
    df = spark.createDataFrame([(None, str(i), 1.0) for i in range(50)] + [("a", "x", None), ("a", "y", 2.0)], "d string, id string, x double")
    got = ranking.with_ranks(df, ["d"], ["x"], ["id"])
    assert got.count() == 52
    known = got.where("x__lt is not null").collect()
    assert [(r.id, r.x__lt, r.x__eq, r.x__n) for r in known] == [("y", 0, 1, 1)]


@pytest.mark.parametrize("values", ["many", "one"])
def test_rows_that_share_their_ids(spark, values):
    """Thousands of rows of one id in a narrow span are cut by value; copies of one row end the cutting."""
    from tidemark.session import MAX_CUTS_KEY, ROWS_PER_BUCKET_KEY

    rows = [("g", f"E{i}", float(i)) for i in range(600)]
    rows += [("g", "same", 300 + (i / 4000 if values == "many" else 0.5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, e string, x double").repartition(5)
    spark.conf.set(ROWS_PER_BUCKET_KEY, "64")
    spark.conf.set(MAX_CUTS_KEY, "8")
    try:
        got = [(r["x"], r["x__lt"], r["x__eq"]) for r in ranking.with_ranks(df, ["g"], ["x"], ["e"]).collect()]
    finally:
        spark.conf.unset(ROWS_PER_BUCKET_KEY)
        spark.conf.unset(MAX_CUTS_KEY)
    ordered = sorted(x for _, _, x in rows)
    assert sorted(got) == sorted((x, bisect.bisect_left(ordered, x), bisect.bisect_right(ordered, x) - bisect.bisect_left(ordered, x)) for x in ordered)
