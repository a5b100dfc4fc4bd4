import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, position int, grp string, path string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    cells = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if c is None else f"{len(c.encode())}:{c}" for c in cells])


def climb(nodes):
    """The last node, and each first node's siblings, left and right, level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, theirs = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            theirs.append([i for k in range(len(run)) for i in owners[at + k]])
        nodes, owners = above, theirs
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in order:
        leaves = sorted((r[0] is not None, r[0] or 0, leaf_of(*r[:5])) for r in groups[s])
        trees[s] = leaves, *climb([x[2] for x in leaves])
    root, above = climb([trees[s][1] for s in order])
    for s, up in zip(order, above, strict=True):
        leaves, top, paths = trees[s]
        out += [(x[1] if x[0] else None, x[2], top, root, tuple(p + up)) for x, p in zip(leaves, paths, strict=True)]
    return out


def as_tuples(found):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"])) for r in found.collect()]


def documents(spark):
    rng = random.Random(3)
    extra = ("x", "y", 1, "g", "p")
    rows = [(i, f"text {i}\n" * rng.randrange(4), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "é", None]), i % 9 or None, *extra) for i in range(700)]
    rows += [(5, "text", "en", "b", 1, *extra)] * 3  # repeated rows and ids
    rows += [(5, "other", "en", "b", 1, *extra), (None, "no id", None, "b", None, *extra), (None, None, None, None, None, *extra)]
    rows += [(900, None, None, "lone", None, *extra), (901, "", "", "", 0, *extra), (902, "é\n" * 200_000, "fr", "long", 1, *extra), (903, "-", "0:", "-", 1, *extra)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_against_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3**height)
    rows, docs = documents(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(as_tuples(merkle.manifest(docs)), key=key) == sorted(brute(rows), key=key)


def test_changed_rows_do_not_fold_to_the_root(spark):
    _, docs = documents(spark)
    cut = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, revised={"text": cut}).withColumn("same", merkle.folded(F.col("revised_leaf"), F.col("path")) == F.col("root"))
    joined = found.join(docs.select("doc_id", "text", "source"), "doc_id").where("doc_id > 10")
    for r in joined.select("doc_id", "text", "same").collect():
        assert r["same"] == (r["doc_id"] % 2 == 1 or "\n" not in (r["text"] or ""))
    assert found.where("not same").count() > 200


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "a", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf_of(7, "a", None, "s", None) and row["path"] == []
    assert merkle.manifest(one.limit(0)).count() == 0
