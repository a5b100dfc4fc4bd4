import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from test_linededup import brute as removed_lines
from test_packing import whole_ids
from test_simhash import brute_components, brute_print
from tidemark.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, copy string"


def make_rows():
    rng = random.Random(8)
    words = {"en": "the and of to water house thing which would there".split(), "de": "der und von zu wasser haus sache welche würde dort".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rng.choice(words[lang]) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(rng.randrange(3, 20))) for _ in range(rng.randrange(1, 8))]
        rows.append((i, "\n".join(lines), lang, ["hot", "hot", "s1", None][i % 4]))
    for i in range(120, 150):  # copies and near copies
        text = rows[i - 100][1]
        rows.append((i, text if i % 2 else text + " extra9", "en", "hot"))
    rows += [(200, None, "en", "hot"), (201, "", None, "hot"), (202, "12 34 !!", "en", None), (None, "the water of the house would there", "en", "s1"), (203, "the house " * 9000, None, "s1"), (5, rows[5][1], *rows[5][2:])]
    return [(*r, len(r[1] or ""), "r", "c") for r in rows]


def rate_of(rows):
    chars = defaultdict(int)
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    weights = {s: math.sqrt(c) for s, c in chars.items()}
    return {s: weights[s] / sum(weights.values()) * sum(chars.values()) / c if c else 1.0 for s, c in chars.items()}


def poisson(doc_id, text, rate):
    key = str(doc_id) if doc_id is not None else hashlib.md5(text.encode()).hexdigest()
    u = int(hashlib.md5(f"11:count:{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, below, mass = 0, math.exp(-rate), math.exp(-rate)
    while u >= below and k < 1000:
        k += 1
        mass *= rate / k
        below += mass
    return k


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(make_rows(), SCHEMA)
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        seen.append(out.collect())
        docs = spark.createDataFrame(seen[-1], out.schema)
    return seen


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "packing"]
    assert all(list(rows[0].__fields__) == [c.split()[0] for c in SCHEMA.split(", ")] for rows in stages[:-1])


def test_language_stage(spark, stages):
    model = langid.train(spark.createDataFrame(stages[0], SCHEMA))
    names, scores = zip(*[(n[0], s[0]) for n, s in (model.predict([r["text"]]) for r in stages[0])], strict=True)
    want = [r for r, n, s in zip(stages[0], names, scores, strict=True) if n != "und" and s > 0]
    assert sorted(map(key, want)) == sorted(map(key, stages[1]))
    assert not {200, 201, 202} & {r["doc_id"] for r in stages[1]} and len(want) >= len(stages[0]) - 6


def test_line_stage(stages):
    order = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in stages[1]})
    gone = removed_lines([(d, t) for d, t in (((n, i), t) for n, i, t in order)])
    want = []
    for r in stages[1]:
        cut = gone.get((r["doc_id"] is None, r["doc_id"] or 0), ())
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in cut)
        if text.split() or not cut:
            want.append((r["doc_id"], text, *list(r)[2:4], len(text), "r", "c"))
    assert sorted(map(key, want)) == sorted(map(key, stages[2]))


def test_near_stage(stages):
    rows = stages[2]
    roots = brute_components([brute_print(r["text"]) for r in rows])
    groups = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        groups[root].append(r)
    want = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert sorted(map(key, want)) == sorted(map(key, stages[3])) and len(want) < len(rows)


def test_mixing_stage(stages):
    rates = rate_of(stages[3])
    want = Counter()
    for r in stages[3]:
        want[tuple(r)] += poisson(r["doc_id"], r["text"], rates[r["source"]])
    assert Counter(map(tuple, stages[4])) == +want


def test_packing_stage(stages):
    want = Counter()
    for r in stages[4]:
        ids = whole_ids(r["text"])
        for at in range(0, len(ids), 2048):
            want[r["doc_id"], at, ids[at : at + 2048].tobytes()] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in stages[5]) == want
    fill = defaultdict(list)
    for r in stages[5]:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run_on_given_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, None)
        assert empty.count() == 0


@pytest.mark.parametrize("label", [None, "12 34"])
def test_language_stage_without_a_learned_language(spark, label):
    texts = ["the house of water", None, "", "12 34 !!", "é", "der und von"]
    rows = [(i, t, None, "s", 0, "r", "c") for i, t in enumerate(texts)]
    if label:
        rows.append((9, label, "en", "s", 0, "r", "c"))
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5]
