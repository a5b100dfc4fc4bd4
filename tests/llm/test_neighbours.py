import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, id string, vector int"


def run(spark, rows, queries, **options):
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    found = {}
    for r in neighbours.nearest_neighbours(frame, queries, **options).collect():
        found.setdefault(r[0], {})[r[1]] = (r[2], r[3])
    return {q: [v[i] for i in sorted(v)] for q, v in found.items()}


def brute(rows, is_query, k=10):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in kept if j != i)[:k] for i, v in kept if is_query(i)}


def test_exact_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(100, 160)]  # a group of copies
    rows += [(200, None), (300, []), (400, [0.0] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (700, [float("inf")] + [1.0] * 5)]
    got = run(spark, rows, F.col("id") % 20 == 0, tables=12, target=1.0, block_rows=7)
    want = brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q in got:  # copies tie: the smaller ids must win
        assert [round(d, 9) for _, d in got[q]] == [round(d, 9) for d, _ in want[q]]
    copies = [j for j in [0, *range(100, 160)]]
    for q in (0, 100, 120, 140):
        assert [v for v, _ in got[q]] == [j for j in copies if j != q][:10]


def test_few_rows_give_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [90.0, 1.0]), (2, [90.0, 1.0])]
    assert [v for v, _ in run(spark, rows, F.col("id") == 0)[0]] == [1, 2]
    assert run(spark, rows[:1], F.col("id") == 0) == {}
    assert run(spark, [], F.col("id") == 0) == {}


def test_recall_on_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in frame.select("vec_id", "embedding").collect()]
    got = run(spark, rows, F.col("id") % 100 == 0)
    want = brute(rows, lambda i: i % 100 == 0)
    hits = [len({v for v, _ in got[q]} & {v for _, v in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
