import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical

UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, score long, rank int, h long"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, top):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = set()
    for i, own in wanted.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out |= {(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)}
    return out


def hostile(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ÉTÉ", "été", "a1", "x_y", "naïve", "🙂", "zz", "b-c", "K", "the\x7f", "\x85", *[f"w{i}" for i in range(60)]]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ".", "\n", "_", "\x00"]) for _ in range(k))
    docs = [(i, text(rng.randrange(25))) for i in range(n)]
    copies = text(20)
    docs += [(10_000 + i, copies) for i in range(n)]  # a large class, and one whose members share an id
    docs += [(7, docs[7][1])] * 3 + [(None, copies), (None, None), (20_000, None), (20_001, ""), (20_002, "...")]
    items = [(i, text(rng.randrange(12))) for i in range(9)] + [(3, "w1 w2"), (50, copies), (51, None), (52, "unseen"), (None, "the w3")]
    return docs, items


@pytest.mark.parametrize("top", [3, 50])
def test_ranks_against_brute_force(spark, top):
    docs, items = hostile(1, 150)
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS).repartition(7)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    got = {tuple(r) for r in lexical.search(frame, asked, top).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == brute(docs, items, top)
    blocks = {tuple(r) for r in lexical.search(frame, asked, top, block_terms=20).select("item_id", "rank", "doc_id", "score").collect()}
    assert blocks == got


def test_equal_hashes_of_different_vectors(spark, monkeypatch):
    monkeypatch.setattr(lexical, "class_hash", lambda vec, m: F.pmod(F.xxhash64(vec), F.lit(3)))
    docs, items = hostile(2, 120)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lexical.search(frame, asked, 10).collect()} == brute(docs, items, 10)


def test_parts_of_long_texts_and_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_EXPANDED", 50)
    docs, items = hostile(3, 60)
    docs.append((30_000, "The w1-w2 été " * 200_000 + "w5"))
    docs.append((30_001, "w" * 3_000_000 + " w1"))
    for _, text in docs[-2:]:
        assert lexical.term_counts(text.encode()) == Counter(t.encode() for t in terms_of(text))
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lexical.search(frame, asked, 20).collect()} == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = hostile(4, 5)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(frame.limit(0), asked).count() == 0
    assert lexical.search(frame, asked.limit(0)).count() == 0
    assert lexical.search(frame.where("text = '...'"), asked).count() == 0
