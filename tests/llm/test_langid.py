import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, queries


def brute_phrases(text, sample, block=langid.BLOCK):
    count = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in sample:
                n += 1
            count, i = count + 1, i + n
    return count


def test_phrases_against_substring_search():
    texts = {"a": ["The cat sat on the mat and the dog ran."], "b": ["Der Hund lief und die Katze saß auf der Matte."]}
    model = langid.Model.train(texts)
    asked = ["the dog sat", "die katze und der hund", "zzz qqq", "x", "the mat " * 200]
    plain = [langid.normalise(t) for t in asked]
    samples = [" ".join(map(langid.normalise, texts[k])) for k in model.languages]
    want = [[brute_phrases(t, s) for s in samples] for t in plain]
    got = model.phrases(plain)
    # a symbol that no sample holds is a phrase of its own in either
    assert got.tolist() == want


def test_odd_texts_and_columns(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "", None, "s"), (5, "123 !!", "de", "s"), (6, "² ½", "de", "s"), (None, "the dog", "en", "s"), (1, "the cat and the dog", "en", "s"), (7, "the dog " * 50_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = {(r[0], r[2]) for r in langid.predict(docs, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "en"), (7, "en")}
    empty = langid.train(docs.limit(0))
    assert {r[2] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.predict(docs, langid.train(docs.where("lang = 'en'"))).where("lang_pred not in ('en', 'und')").count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_cross_parsing_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
