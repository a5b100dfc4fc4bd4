import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_date
from tidemark.operators import asof, calendar, cleaning, descriptive, folds, labels, membership, predictions, scaling
from tidemark.session import ROWS_PER_BUCKET_KEY


def day(n):
    """The n-th day from 2020-01-01 on, as eight digits."""
    import datetime

    return (datetime.date(2020, 1, 1) + datetime.timedelta(days=n)).strftime("%Y%m%d")


# --- as-of joins ----


@pytest.mark.parametrize(("max_age", "width"), [(None, 4), (40, 4), (40, 6), (0, 8), (1000, 1)])
def test_asof_against_plain_search(spark, max_age, width):
    rng = random.Random(width)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(900), None]), i) for i in range(300)]
    left += left[:5]  # repeated rows stay
    right = [(rng.choice(["a", "b", None]), rng.randrange(100, 800), rng.randrange(3), rng.random()) for _ in range(60)]
    right += [("a", 200, 1, 0.5), ("a", 200, 1, 0.7), ("a", 200, 0, 0.9)]  # ties on a date
    lf = spark.createDataFrame([(k, None if d is None else day(d), i) for k, d, i in left], "k string, trade_date string, i int").repartition(4)
    rf = spark.createDataFrame([(k, day(d), r, v) for k, d, r, v in right], "k string, trade_date string, seen int, v double")
    got = asof.asof_join(lf, rf, ["k"], ["v"], recency=["seen"], max_age_days=max_age, bucket=lambda c: F.substring(c, 1, width)).collect()
    want = []
    for k, d, i in left:
        known = [x for x in right if k is not None and d is not None and x[0] == k and x[1] <= d]
        best = max(known, key=lambda x: (x[1], x[2], x[3]), default=None)
        if best is None or (max_age is not None and d - best[1] > max_age):
            best = (None, None, None, None)
        want.append((k, None if d is None else day(d), i, None if best[1] is None else day(best[1]), best[3]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_membership_on_days(spark):
    snapshots = spark.createDataFrame(
        [("I", e, day(d), 1.0 + d) for d, members in ((10, "AB"), (50, "BC"), (400, "C")) for e in members] + [("J", "Z", day(30), 2.0)],
        "index_code string, ts_code string, trade_date string, index_weight double",
    )
    days = spark.createDataFrame([(i, day(d)) for i in "IJK" for d in (5, 10, 20, 50, 140, 200, 399, 405)], "index_code string, trade_date string")
    got = {(r["index_code"], r["trade_date"], r["ts_code"]) for r in membership.membership_on(days, snapshots, max_age_days=100).collect()}
    want = {("I", day(d), e) for d, members in ((10, "AB"), (20, "AB"), (50, "BC"), (140, "BC"), (405, "C")) for e in members}
    assert got == want | {("J", day(50), "Z")}
    assert membership.membership_on(days, snapshots.limit(0)).count() == 0


# --- prediction scores ----


@pytest.mark.parametrize("bucket_rows", ["10", "1000000"])
def test_scores_by_plain_loops(spark, bucket_rows):
    rng = random.Random(8)
    rows = [(rng.choice(["train", "test", None]), day(i % 7), f"E{i:03d}", rng.choice([rng.randrange(6) / 2, None, float("nan")]), rng.gauss(0, 1)) for i in range(400)]
    rows += [("one sided", day(0), f"E{i}", float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "split string, trade_date string, ts_code string, p double, y double")
    spark.conf.set(ROWS_PER_BUCKET_KEY, bucket_rows)
    try:
        got = {r["split"]: r for r in predictions.score(df, "p", "y", min_cross_section=3).collect()}
    finally:
        spark.conf.unset(ROWS_PER_BUCKET_KEY)
    known = [r for r in rows if r[0] and r[3] is not None and r[3] == r[3]]
    assert set(got) == {r[0] for r in known}
    for split, r in got.items():
        own = [x for x in known if x[0] == split]
        assert r["rows"] == len(own)
        assert r["mse"] == pytest.approx(statistics.fmean((p - y) ** 2 for *_, p, y in own))
        assert r["mae"] == pytest.approx(statistics.fmean(abs(p - y) for *_, p, y in own))
        up, down = [p for *_, p, y in own if y > 0], [p for *_, p, y in own if y <= 0]
        assert (r["positives"], r["negatives"]) == (len(up), len(down))
        if up and down:
            wins = sum((a > b) + (a == b) / 2 for a in up for b in down)
            assert r["auc"] == pytest.approx(wins / len(up) / len(down))
        else:
            assert r["auc"] is None
        daily = []
        for d in {x[1] for x in own}:
            pairs = [(p, y) for _, dd, _, p, y in own if dd == d]
            if len(pairs) >= 3 and len({p for p, _ in pairs}) > 1 and len({y for _, y in pairs}) > 1:
                daily.append(statistics.correlation(*zip(*pairs, strict=True)))
        if len(daily) > 1:
            assert r["ic_mean"] == pytest.approx(statistics.fmean(daily))
            assert r["icir"] == pytest.approx(statistics.fmean(daily) / statistics.stdev(daily))
    assert predictions.score(df.limit(0), "p", "y").count() == 0


# --- folds ----


def test_fold_ranges():
    assert folds.fold_ranges(10, 4, 3) == [(1, 0, 3, 4, 6), (2, 0, 6, 7, 9)]
    assert folds.fold_ranges(11, 4, 3, train_days=2, gap_days=1) == [(1, 1, 2, 4, 6), (2, 4, 5, 7, 9), (3, 7, 8, 10, 10)]
    assert folds.fold_ranges(5, 1, 2, gap_days=1) == [(1, 0, 1, 3, 4)]
    with pytest.raises(ValueError, match="at least one day"):
        folds.fold_ranges(5, 2, 0)
    assert folds.fold_ranges(5, 0, 2) == [(1, 0, 1, 2, 3), (2, 0, 3, 4, 4)]


@pytest.mark.parametrize(("train_days", "horizon", "gap"), [(None, 2, 0), (6, 3, 1), (4, 0, 0)])
def test_folds_do_not_leak(spark, train_days, horizon, gap):
    rng = random.Random(1)
    rows = [(day(d), f"E{e}", e) for d in range(30) for e in range(6) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, payload int")
    got = {(r["trade_date"], r["ts_code"], r["fold"], r["part"]) for r in folds.walk_forward(df, day(12), 5, train_days, horizon, gap).collect()}
    calendar = sorted({d for d, _, _ in rows})
    first = sum(d < day(12) for d in calendar)
    want, number = set(), 0
    for start in range(first, len(calendar), 5):
        end = start - 1 - gap
        begin = 0 if train_days is None else max(0, end - train_days + 1)
        number += 1
        for d, e, _ in rows:
            at = calendar.index(d)
            later = sorted(x for x, y, _ in rows if y == e and x > d)
            known = d if horizon == 0 else later[horizon - 1] if len(later) >= horizon else None
            if start <= at < start + 5:
                want.add((d, e, number, "test"))
            elif begin <= at <= end and known is not None and known < calendar[start]:
                want.add((d, e, number, "train"))
    assert got == want and {p for *_, p in want} == {"train", "test"}
    assert folds.walk_forward(df.limit(0), day(12), 5).count() == 0
    assert folds.walk_forward(df, day(900), 5).count() == 0


# --- scaling ----


def panel(spark, days=4, entities=50):
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("inf"), 0.0, 1.0, *[rng.gauss(0, 3) for _ in range(8)]])
    rows = [(day(d), f"E{e:02d}", value(), 7.0, None) for d in range(days) for e in range(entities)]
    return rows, spark.createDataFrame(rows, "trade_date string, ts_code string, a double, b double, c double")


def sides(values, robust):
    values = [v for v in values if v is not None and abs(v) != float("inf")]
    if not values:
        return None, None
    if robust:
        center = statistics.median(values)
        return center, statistics.median(abs(v - center) for v in values)
    return statistics.fmean(values), statistics.stdev(values) if len(values) > 1 else None


@pytest.mark.parametrize("robust", [True, False])
def test_cross_section_and_scaler_by_plain_loops(spark, tiny_buckets, robust):
    rows, df = panel(spark)
    method = scaling.ROBUST if robust else scaling.STANDARD
    got = {(r["trade_date"], r["ts_code"], r["feature"]): r["z"] for r in scaling.cross_section_z(df, ["a", "b", "c"], method, limit=2.0).collect()}
    assert len(got) == 3 * len(rows)
    for d, e, a, _, _ in rows:
        center, spread = sides([x[2] for x in rows if x[0] == d], robust)
        if a is None or abs(a) == float("inf"):
            assert got[d, e, "a"] is None
        else:
            assert got[d, e, "a"] == pytest.approx(max(-2, min(2, (a - center) / spread)))
        assert got[d, e, "b"] is None and got[d, e, "c"] is None  # no spread, no values
    train = df.where(F.col("trade_date") < day(2))
    scaler = scaling.fit_scaler(train, ["a", "b", "c"], method)
    table = {r["feature"]: r for r in scaler.collect()}
    center, spread = sides([x[2] for x in rows if x[0] < day(2)], robust)
    assert table["a"]["center"] == pytest.approx(center) and table["a"]["spread"] == pytest.approx(spread)
    assert (table["b"]["center"], table["b"]["spread"], table["c"]["n"], table["c"]["center"]) == (7.0, 0.0, 0, None)
    scaled = {(r["trade_date"], r["ts_code"]): r for r in scaling.apply_scaler(df, scaler).collect()}
    for d, e, a, _, _ in rows:
        if a is not None and abs(a) != float("inf"):
            assert scaled[d, e]["a"] == pytest.approx((a - center) / spread)
        assert scaled[d, e]["b"] is None
    with pytest.raises(ValueError, match="lacks columns"):
        scaling.apply_scaler(df.drop("a"), scaler)


# --- cleaning ----


def test_cleaning_counts_in_one_scan(spark):
    rng = random.Random(6)
    cell = lambda *odd: rng.choice([*odd, 2.0, 3.0, 4.0])
    rows = [(i, cell(None), cell(1.0), cell(5.0), cell(-1.0, 0.0, None), cell(-2.0, None)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, open double, high double, low double, close double, vol double").repartition(6)
    kept, counts = cleaning.clean(df, watched=["vol"])

    def broken(r):
        _, o, h, low, c, v = r
        checks = {"missing_price": None in (o, h, low, c), "close_not_positive": c is not None and c <= 0, "high_below_low": h < low, "negative_volume": v is not None and v < 0}
        return [n for n, hit in checks.items() if hit]

    hits = {r[0]: broken(r) for r in rows}
    assert {r["id"] for r in kept.collect()} == {i for i, b in hits.items() if not b}
    assert kept.columns == df.columns
    table = {(r["section"], r["name"]): r["rows"] for r in counts.collect()}
    for name in cleaning.PRICE_RULES:
        assert table["broken", name] == sum(name in b for b in hits.values())
        assert table["removed", name] == sum(b[:1] == [name] for b in hits.values())
    assert table["rows", "before"] == 500 and table["rows", "after"] == kept.count()
    assert sum(n for (s, _), n in table.items() if s == "removed") == 500 - kept.count()
    assert table["missing_before", "vol"] == sum(r[5] is None for r in rows)
    assert table["missing_after", "vol"] == sum(r[5] is None and not hits[r[0]] for r in rows)
    empty, zero = cleaning.clean(df.limit(0))
    assert empty.count() == 0 and {r["rows"] for r in zero.collect()} == {0}


def test_a_failed_task_is_counted_once(spark, tmp_path):
    """A task that fails after its rows were seen runs again; local mode allows no retry, so the whole write is repeated here."""
    flag = tmp_path / "failed"

    def once(batches):
        for i, batch in enumerate(batches):
            yield batch
        if not flag.exists():
            flag.write_text("x")
            raise RuntimeError("lost")

    df = spark.range(1000).selectExpr("id", "2.0D AS open", "2.0D AS high", "1.0D AS low", "id - 10.0D AS close", "1.0D AS vol").coalesce(1)
    failing = df.mapInArrow(once, df.schema)
    with pytest.raises(Exception, match="lost"):
        cleaning.clean(failing)
    kept, counts = cleaning.clean(failing)
    table = {(r["section"], r["name"]): r["rows"] for r in counts.collect()}
    assert table["rows", "before"] == 1000 and table["rows", "after"] == kept.count() == 989


def test_dates_are_days(spark):
    assert spark.range(1).select(F.date_diff(as_date(F.lit("20200301")), as_date(F.lit("20200228")))).first()[0] == 2


# --- labels, descriptive tables, calendar ----


def test_forward_labels_by_plain_loops(spark, tiny_buckets):
    rng = random.Random(12)
    rows = [(day(d), f"E{e}", "AB"[e % 2], rng.choice([None, *[rng.uniform(5, 9) for _ in range(9)]])) for d in range(25) for e in range(8) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, industry string, close double")
    bench = {h: spark.createDataFrame([(day(d), d / 1000 * h) for d in range(20)], "trade_date string, benchmark_future_return double") for h in (1, 3)}
    got = {(r["trade_date"], r["ts_code"]): r for r in labels.forward_labels(df, bench, (1, 3), main=3, top=0.25).collect()}
    assert len(got) == len(rows)
    main = {}
    for d, e, _, close in rows:
        own = sorted((x, c) for x, y, _, c in rows if y == e)
        at = own.index((d, close))
        r = got[d, e]
        for h in (1, 3):
            ahead = own[at + 1 : at + 1 + h]
            mature = len(ahead) == h
            assert r[f"known_on_{h}"] == (ahead[-1][0] if mature else None)
            ret = ahead[-1][1] / close - 1 if mature and close and ahead[-1][1] else None
            assert r[f"y_ret_{h}"] == (None if ret is None else pytest.approx(ret))
            assert r[f"y_up_{h}"] == (None if ret is None else int(ret > 0))
            whole = mature and close and all(c for _, c in ahead)
            assert r[f"y_worst_{h}"] == (pytest.approx(min(c for _, c in ahead) / close - 1) if whole else None)
            assert r[f"y_best_{h}"] == (pytest.approx(max(c for _, c in ahead) / close - 1) if whole else None)
            if h == 3 and whole:
                path = [close, *[c for _, c in ahead]]
                steps = [b / a - 1 for a, b in zip(path, path[1:], strict=False)]
                assert r["y_risk_3"] == pytest.approx(ret / statistics.stdev(steps) / 3**0.5)
            number = next(n for n in range(25) if day(n) == d)
            assert r[f"y_excess_{h}"] == (pytest.approx(ret - number / 1000 * h) if ret is not None and number < 20 else None)
        main[d, e] = r["y_ret_3"]
    for d, e, industry, _ in rows:
        y, r = main[d, e], got[d, e]
        peers = [v for (x, _), v in main.items() if x == d and v is not None]
        if y is None:
            assert r["y_rank"] is r["y_top"] is r["y_winsor"] is r["y_neutral"] is None
            continue
        assert r["y_rank"] == pytest.approx((sum(v < y for v in peers) + (sum(v == y for v in peers) + 1) / 2) / len(peers))
        assert r["y_top"] == int((sum(v > y for v in peers) + (sum(v == y for v in peers) + 1) / 2) / len(peers) <= 0.25)
        own = [main[x, z] for x, z, i, _ in rows if x == d and i == industry and main[x, z] is not None]
        assert r["y_neutral"] == pytest.approx(y - statistics.fmean(own))
        assert min(peers) <= r["y_winsor"] <= max(peers)


def test_label_leaks_are_found(spark):
    df = spark.createDataFrame([(day(d), "E", float(d)) for d in range(20)], "trade_date string, ts_code string, close double")

    def build(panel):
        ahead = lambda h: F.expr(f"lead(close, {h}) OVER (PARTITION BY ts_code ORDER BY trade_date)")
        return panel.select("trade_date", "ts_code", ahead(2).alias("good"), ahead(3).alias("bad"), F.expr("lead(trade_date, 2) OVER (PARTITION BY ts_code ORDER BY trade_date)").alias("known_on"))

    got = {(r["trade_date"], r["label"]) for r in labels.label_leaks(build, df, day(10), {"good": "known_on", "bad": "known_on"}).collect()}
    assert got == {(day(8), "bad")}


def test_histogram_by_plain_loops(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, float("nan"), rng.gauss(0, 2), rng.gauss(0, 2)]), 3.0, None) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, c double, n double")
    frames = [descriptive.histogram(df.repartition(p), ["x", "c", "n"], 7, ["g"]) for p in (1, 5)]
    tables = [{(r["g"], r["column"], r["bin"]): (r["rows"], r["low"], r["high"]) for r in f.collect()} for f in frames]
    assert tables[0] == tables[1]
    known = [x for _, x, _, _ in rows if x is not None and x == x]
    low, width = min(known), (max(known) - min(known)) / 7
    for (g, column, b), (n, lo, hi) in tables[0].items():
        own = [r for r in rows if r[0] == g]
        if column == "x":
            bins = [-1 if x is None or x != x else min(6, int((x - low) / width)) for _, x, _, _ in own]
            assert n == bins.count(b)
            if b >= 0:
                assert (lo, hi) == (pytest.approx(low + b * width), pytest.approx(low + (b + 1) * width))
        else:
            assert (b, n) == (0 if column == "c" else -1, len(own))
    assert sum(n for (_, c, _), (n, _, _) in tables[0].items() if c == "x") == 500
    assert descriptive.histogram(df.limit(0), ["x"], 7).count() == 0


def test_holiday_distance(spark):
    opened = [0, 1, 2, 5, 6, 10, 11, 12, 13, 20]  # 2 -> 5 is a weekend, 6 -> 10 and 13 -> 20 are holidays
    days = spark.createDataFrame([(day(d),) for d in opened + [5]], "cal_date string")
    got = {r["cal_date"]: (r["days_since_holiday"], r["days_to_holiday"]) for r in calendar.holiday_distance(days).collect()}
    want = {0: (None, 5), 1: (None, 4), 2: (None, 3), 5: (None, 2), 6: (None, 1), 10: (1, 4), 11: (2, 3), 12: (3, 2), 13: (4, 1), 20: (1, None)}
    assert got == {day(d): w for d, w in want.items()}
    assert calendar.holiday_distance(days.limit(0)).count() == 0


def test_sizes_and_running_sums(spark):
    df = spark.createDataFrame([("d1", "a", "x"), ("d1", "b", "x"), ("d1", "c", "y"), ("d2", "a", "x")], "trade_date string, ts_code string, industry string")
    got = {(r["trade_date"], r["industry"]): (r["rows"], r["entities"], r["share"]) for r in descriptive.group_sizes(df, ["trade_date", "industry"], ["trade_date"]).collect()}
    assert got == {("d1", "x"): (2, 2, 2 / 3), ("d1", "y"): (1, 1, 1 / 3), ("d2", "x"): (1, 1, 1.0)}
    daily = spark.createDataFrame([("d1", "f", 0.5, None), ("d2", "f", None, 0.25), ("d3", "f", 0.25, 0.5)], "trade_date string, feature string, ic double, rank_ic double")
    got = [tuple(r)[2:] for r in descriptive.cumulative_ic(daily).orderBy("trade_date").collect()]
    assert got == [(0.5, 0.0), (0.5, 0.25), (0.75, 0.75)]
