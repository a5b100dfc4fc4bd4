import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import packing, token_store
from tidemark.llm.encoding import id_width, tokenizer_path


def wide_vocabulary(folder):
    """A tokenizer file of 70,000 whole words and an unknown one."""
    words = {f"w{i}": i for i in range(70_000)} | {"[UNK]": 70_000}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = f"{folder}/wide.json"
    tokenizer.save(path)
    return path


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    for start in {0, len(values) // 3, min(255, len(values)), min(256, len(values)), min(257, len(values))}:
        for stop in {start, len(values), min(len(values), start + 256), min(len(values), start + 511)}:
            assert coded.block(start, stop).tolist() == values[start:stop]
    assert [coded.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000)).astype(np.uint64)
    assert len(token_store.EliasFano.encode(ends).to_bytes()) < 20_000 * 13 / 8 + 1000


def test_files_read_back(spark, tmp_path):
    texts = {5: "The cat sat.", 2: None, 9: "", 7: "word " * 40_000, -3: "Ünï cödé", 11: "last one"}
    rows = [(k, v, "x", 1) for k, v in texts.items()] + [(None, "no id", "x", 1), (5, "The cat sat.", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, key int")
    manifest = token_store.write_token_store(docs, folder=f"file://{tmp_path}/store", shard_ids=1000)
    got = token_store.read_token_store(spark, manifest).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    tokenizer, start = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0
    for r, (doc_id, text) in zip(got, sorted(((x[0], x[1]) for x in rows), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert zlib.crc32(r["ids"]) == zlib.crc32(ids.tobytes())
        start += len(ids)
    for row in manifest.collect():
        shard = token_store.Shard(row["file"])
        for i in range(shard.n_docs):
            assert shard.document(i)[-1] == 2 and len(shard.document(i)) == shard.offset(i + 1) - shard.offset(i)
            shard.doc_id(i)
    empty = token_store.write_token_store(docs.limit(0), folder=f"file://{tmp_path}/none")
    assert token_store.read_token_store(spark, empty).count() == 0


def test_wide_vocabulary(spark, tmp_path):
    """Ids above 65,535 take four bytes, and two are refused."""
    path = wide_vocabulary(tmp_path)
    docs = spark.createDataFrame([(i, f"w{i} w69999 w65536 w1") for i in range(65_500, 65_600)] + [(70_000, None)], "doc_id long, text string")
    store = token_store.write_token_store(docs, folder=f"file://{tmp_path}/wide", path=path, style="byte")
    assert {token_store.Shard(r["file"]).width for r in store.collect()} == {4}
    for r in token_store.read_token_store(spark, store).collect():
        own = [] if r["doc_id"] == 70_000 else [r["doc_id"], 69_999, 65_536, 1]
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == [*own, 2]
    with pytest.raises(ValueError, match="do not fit"):
        token_store.write_token_store(docs, folder=f"file://{tmp_path}/narrow", path=path, width=2)
    packed = packing.pack_documents(docs, path=path, seq_len=2).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p"))
    for r in packed.collect():
        own = [] if r["doc_id"] == 70_000 else [r["doc_id"], 69_999, 65_536, 1]
        assert np.concatenate([np.frombuffer(x["ids"], dtype="<u4") for x in r["p"]]).tolist() == [*own, 1]
    with pytest.raises(ValueError, match="do not fit"):
        packing.pack_documents(docs, path=path, width=2)
    assert id_width(path) == 4 and id_width(tokenizer_path("word_bpe_49k.json")) == 2 and id_width(tokenizer_path("word_bpe_49k.json"), 1 << 16) == 4
