import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_print(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_fingerprint_against_definition():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É É é ß a b c d", "x " * 500, "the cat sat on the mat the cat sat"]
    for text in texts:
        assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_links_against_all_pairs(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(500):
        value = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(64)
        prints.add(value)
    prints = sorted(prints)
    labels = simhash.trie_links(np.array(prints, dtype=np.uint64), np.zeros(len(prints), dtype=np.int64))
    assert labels.tolist() == brute_components(prints)


@pytest.mark.parametrize("group_rows", [20_000, 12])
def test_near_duplicates_whole(spark, group_rows):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(120)]
        texts += [" ".join(words)] * rng.randrange(1, 4)
        for _ in range(rng.randrange(5)):
            changed = list(words)
            changed[rng.randrange(120)] = "new"
            texts.append(" ".join(changed))
    texts += [None, "", "  ", "a", "A"]
    rows = [(i, t, "x", 9) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, component_id long")
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs, group_rows=group_rows).select("doc_id", simhash.hexadecimal(F.col("print")), "component_id").collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints)
    assert got == {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots, strict=True))}


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (5, "other text here now"), (None, "a b c d"), (None, "only null ids")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert len(got) == 5
    assert sorted((r[0] is None, r[1]) for r in got if r[1] is not None) == [(False, 5)] * 3 + [(True, 5)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
