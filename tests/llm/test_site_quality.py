import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import site_quality
from tidemark.llm.queries import op9_site_quality



def classify(docs, labels):
    return site_quality.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), ("source", "lang"))


def brute(rows, labels):
    """Scores by plain loops for rows whose texts have only plain words: all scales but size and length are zero."""
    votes = defaultdict(list)
    for doc_id, q in labels:
        if q in (0, 1) and doc_id is not None:
            votes[doc_id].append(q)
    good = {d: int(2 * sum(v) >= len(v)) for d, v in votes.items()}
    known = [(r, good[r[0]]) for r in rows if r[0] in good]
    scales = lambda text: (len(f"{len(text.split()):b}"), min(40, 2 * sum(map(len, text.split())) // max(1, len(text.split()))), 1, 0, 0)
    evidence = []
    for i in range(5):
        n = Counter((scales(r[1] or "")[i], g) for r, g in known)
        steps = {s for s, _ in n}
        t1, t0 = (sum(v for (_, g), v in n.items() if g == y) for y in (1, 0))
        evidence.append({s: math.log((n[s, 1] + 1) / (t1 + len(steps))) - math.log((n[s, 0] + 1) / (t0 + len(steps))) for s in steps})
    host, path = defaultdict(list), defaultdict(list)
    for (_, _, lang, source), g in known:
        host[source].append(g)
        path[source, lang].append(g)
    total = len(known)
    rate = (sum(g for _, g in known) + 1) / (total + 2)
    noise = rate * (1 - rate)

    def strength(spread, groups, squares):
        room = total - squares / total if total else 0
        between = (spread - groups * noise) / room if room > 0 else 0
        return 1e6 if between <= noise / 1e6 else min(1e6, max(1, noise / between - 1))

    mean = lambda v: sum(v) / len(v)
    k = strength(sum(len(v) * (mean(v) - rate) ** 2 for v in host.values()), len(host) - 1, sum(len(v) ** 2 for v in host.values()))
    host_rate = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in host.items()}
    kp = strength(sum(len(v) * (mean(v) - mean(host[h])) ** 2 for (h, _), v in path.items()), len(path) - len(host), total * sum(len(v) ** 2 / len(host[h]) for (h, _), v in path.items()))
    out = []
    for doc_id, text, lang, source in rows:
        above, own = host_rate.get(source, rate), good.get(doc_id)
        v = path.get((source, lang), [])
        p = (sum(v) - (own or 0) + kp * above) / (len(v) - (own is not None) + kp)
        odds = sum(e.get(s, 0) for e, s in zip(evidence, scales(text or ""), strict=True)) + math.log(p / (1 - p))
        out.append((doc_id, round(1 / (1 + math.exp(-odds)), 6)))
    return out


def test_against_loops(spark):
    rows = []
    for i in range(400):
        source = ["big", "big", "s1", "s2", None][i % 5]
        bad = (i * 7919) % 10 < {"big": 2, "s1": 6, "s2": 1, None: 4}[source]
        rows.append((i, " ".join(f"w{i}x{j}" * (2 if bad and i % 3 else 1) for j in range(30 if bad else 70)), ["en", "de"][i % 2], source, bad))
    labels = [(i, 0 if r[4] else 1) for i, r in enumerate(rows) if i % 3] + [(4, 0), (4, 0), (5, None), (7, 3), (9999, 1)]
    rows = [r[:4] for r in rows] + [(1000, None, "en", "new"), (1001, "", None, None), (1, rows[1][1], "en", "big"), (1002, "word%d " * 5, "en", "s1")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, host int, score double")
    graded = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted((r["doc_id"], round(r["score"], 6)) for r in classify(docs, graded).collect() if r["doc_id"] != 1002)
    want = sorted(x for x in brute(rows, labels) if x[0] != 1002)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["score"], r["kept"]) for r in classify(docs, none).collect()] == [(0.5, True)] * 2
    assert classify(docs.limit(0), none).count() == 0


def test_site_of(spark):
    urls = ["http://Blog.Example.com:80/fr/825?x=1", "https://u@a.org", "nothing", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(*site_quality.site_of(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("blog.example.com", "blog.example.com/fr"), ("a.org", "a.org/"), (None, None), (None, None)]


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {r["quality"]: r["share"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.15
    assert op9_site_quality(spark, folder).count() == docs.count()
