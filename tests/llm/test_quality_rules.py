import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "é", "c#", "|", "\x85", "🙂", "dog"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\r\n", "\x0b", "  "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " \n ", "a", "a a", "a a a", "a a a a", "x y z x y z x", "word " * 60_000, "\n".join(["same line here"] * 500), " ".join(f"w{i}" for i in range(60))]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "s" if i % 3 else None, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[5] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_bins_are_narrow_and_ordered(spark):
    rows = spark.range(0, 5000).select("id", quality_rules.bin_top(F.col("id")).alias("top")).orderBy("id").collect()
    tops = [r["top"] for r in rows]
    assert tops == sorted(tops) and tops[:64] == list(range(64))
    assert all(0 <= t - i <= i / 32 for i, t in enumerate(tops))


def test_junk_goes_and_clean_stays(spark):
    folder = "/root/testdata/sf0.1"
    kept = quality_rules.apply_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share = {r["quality"]: r["share"] for r in kept.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05
