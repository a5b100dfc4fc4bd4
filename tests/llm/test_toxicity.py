import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def test_terms_by_plain_loops():
    words = toxicity.words_of("Abcde abcdf ABCDG xyz 12 abc_defgh\nÉtéété été")
    assert words == {"abcde", "abcdf", "abcdg", "xyz", "abc", "defgh", "étéété", "été"}
    found = toxicity.terms_of(words)
    want = set(words)
    for n, times in itertools.product(range(3, 8), (1, 2, 3)):
        beginnings = [w[:n] for w in words if len(w) > n]
        want |= {b + "*" * times for b in beginnings if beginnings.count(b) >= times}
    assert found == want and "abcd***" in found and "été*" in found
    wanted = {"abcd*", "abcd***", "abc***", "xyz", "été", "été**", "none", "abcdefg*"}
    assert toxicity.Vocabulary(wanted).within(words) == wanted & found


def test_words_are_runs_of_letters():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abÉß²½ 1_-.\n\x85\u00a0éǅ日") for _ in range(rng.randrange(40)))
        assert toxicity.words_of(text) == set(re.findall(r"[^\W\d_]+", text.lower()))


def weighted_counts(rows):
    """Pair counts of (votes, toxic share, n) by plain loops."""
    size = len(toxicity.VOTERS)
    pairs = np.zeros((2, size, 3, size, 3))
    for votes, p, n in rows:
        v = [int(c) for c in votes]
        for y, share in ((0, 1 - p), (1, p)):
            for i, j in itertools.product(range(size), repeat=2):
                pairs[y, i, v[i], j, v[j]] += n * share
    return pairs


def planted(n, seed=1):
    """Votes where voter 1 copies voter 0, voters 2-5 are right more or less often, and the rest are silent."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        toxic = rng.random() < 0.2
        right = lambda p, q: "2" if rng.random() < (p if toxic else q) else "0"  # noqa: E731, B023
        votes = ["0"] * len(toxicity.VOTERS)
        votes[0] = votes[1] = right(0.7, 0.2)
        votes[2:6] = [right(0.9, 0.02), right(0.8, 0.05), right(0.9, 0.05), right(0.6, 0.1)]
        rows.append(("".join(votes), int(toxic)))
    return rows


def test_model_is_the_sums_of_plain_loops(spark):
    rows = [(v, float(y), 1 + i % 3) for i, (v, y) in enumerate(planted(60))]
    frame = spark.createDataFrame([(v, int(y), n) for v, y, n in rows], "votes string, label long, n long").repartition(3)
    model = toxicity.learn_label_model(frame, rounds=1)
    want = toxicity.fit_label_model(weighted_counts(rows))
    assert model.parents == want.parents and np.allclose(model.rates, want.rates) and np.allclose(model.share, want.share)
    assert np.allclose(model.rates.sum(axis=3), 1)


def test_accuracies_and_correlations_from_few_labels(spark):
    rows = planted(6000)
    frame = spark.createDataFrame([(v, y if i < 300 else None) for i, (v, y) in enumerate(rows)], "votes string, label long")
    model = toxicity.learn_label_model(frame.groupBy("votes", "label").agg(F.count("*").alias("n")))
    report = {voter: (hit, false, above) for voter, hit, false, above in toxicity.voter_report(model)}
    for voter, hit, false in (("lexicon_0", 0.7, 0.2), ("lexicon_2", 0.9, 0.02), ("lexicon_5", 0.6, 0.1)):
        assert abs(report[voter][0] - hit) < 0.06 and abs(report[voter][1] - false) < 0.03
    assert report["lexicon_1"][2] == "lexicon_0"  # the copy hangs on its original,
    votes = np.zeros((2, len(toxicity.VOTERS)), dtype=np.uint8)
    votes[0, 0], votes[1, :2] = 2, 2
    both, neither = model.log_odds(votes[1:]), model.log_odds(votes[:1] * 0)
    assert abs((both - neither)[0] - (np.log(0.7 / 0.2) - np.log(0.3 / 0.8))) < 0.6  # so two equal votes count once
    guessed = model.posterior(np.array([[int(c) for c in v] for v, _ in rows], dtype=np.uint8)) > 0.5
    assert np.mean(guessed == np.array([y for _, y in rows])) > 0.95


def corpus(spark, n=600):
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "sun", "pel") for b in ("ra", "tin", "mosa", "dok", "ulle", "ven", "gart")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(clean, k=rng.randrange(20, 120))
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = "vrak" + rng.choice(["al", "em", "osh", "ut", "ir"])
        rows.append((i, " ".join(words), "x", 1, "y"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(n, None, "x", 1, "y"), (n + 1, "", "x", 1, "y"), (None, "vrakal vrakut", "x", 1, "y"), (3, "repeated id", "x", 1, "y"), (n + 2, "tarea lomi " * 100_000, "x", 1, "y")]
    labels += [(0, 0), (0, 1), (2, 7), (None, 1), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, votes int, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_unlabelled_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    found = toxicity.score_toxicity(docs, labels, learn=F.col("doc_id") % 3 != 1, fit_rows=500).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == (r["doc_id"] % 6 == 0) or r["doc_id"] == 3
    empty = {r["score"] for r in found if r["doc_id"] in (600, 601)}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_held_out_labels_do_not_count(spark):
    docs, labels = corpus(spark, 300)
    held = F.col("doc_id") % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score_toxicity(docs, x, learn=~held, fit_rows=500).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("which", ["no documents", "no labels", "no text"])
def test_empty_tables(spark, which):
    docs, labels = corpus(spark, 60)
    if which == "no documents":
        assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    elif which == "no labels":
        found = toxicity.score_toxicity(docs, labels.limit(0)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    else:
        found = toxicity.score_toxicity(docs.withColumn("text", F.lit(None).cast("string")), labels).collect()
        assert len({r["score"] for r in found}) == 1


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    judged = toxicity.score_toxicity(docs, labels, learn=~held).join(labels, "doc_id").where(held)
    tp, called, toxic = judged.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.sum("predicted"), F.sum("toxic")).first()
    assert tp / called > 0.93 and tp / toxic > 0.9
