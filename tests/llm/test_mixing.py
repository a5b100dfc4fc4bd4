import math
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, copies int, place string"


def table(spark, n=6000):
    rows = [(i, "x" * 20, ["hot", "hot", "hot", "cold", None][i % 5], 7, "p") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rates_follow_weights_and_counts_are_poisson(spark):
    mixed = mixing.mix_sources(table(spark).withColumnRenamed("copies", "size"), {"hot": 1.0, "cold": 2.0, None: 1.0})
    got = Counter((r[0], r[1]) for r in mixed.groupBy("doc_id", "source").count().collect())
    assert max(got.values()) == 1
    counts = mixed.groupBy("doc_id", "source").count().collect()
    for source, rows, rate in (("hot", 3600, 1500 / 3600), ("cold", 1200, 3000 / 1200), (None, 1200, 1500 / 1200)):
        tally = Counter(r["count"] for r in counts if r["source"] == source)
        total = sum(k * v for k, v in tally.items())
        assert abs(total - rate * rows) < 5 * math.sqrt(rate * rows)
        for k in (1, 2, 3):
            expected = rows * math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(tally[k] - expected) < 5 * math.sqrt(expected) + 1


def test_copies_are_numbered_and_sorted(spark):
    mixed = mixing.mix_sources(table(spark, 400).drop("copies", "place"), power=1.0, size=3.0)
    rows = mixed.withColumn("part", F.spark_partition_id()).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_doc.values())
    for part in {r["part"] for r in rows}:
        places = [r["place"] for r in rows if r["part"] == part]
        assert places == sorted(places)
    assert [r["place"] for r in mixing.mix_sources(table(spark, 400).drop("copies", "place"), power=1.0, size=3.0).orderBy("place").collect()] == sorted(r["place"] for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "empty"), (2, "", "empty"), (None, "same text", "a"), (None, "same text", "a"), (None, None, None), (3, "word " * 100_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, size=4.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "place"]
    twins = mixed.where("source = 'a'").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in twins)
    assert mixing.mix_sources(docs, {}).where("source in ('a', 'b')").count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
