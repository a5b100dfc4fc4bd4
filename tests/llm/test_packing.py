import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from tidemark.llm import packing
from tidemark.llm.encoding import CachedEncoder, tokenizer_path

ODD = ["", " ", "\n", "a\n\nb", "a\n\n\nb", "a  b", "a   b ", "\ta b\t", "x...y ...", "A.B, c.", "don't we're I'LL", "é Σας ΣΑΣ", "a\x1cb \x1f", "12 345,6", "<|endoftext|> a<|endoftext|>b", "日本語 テスト 🙂🙂", "a\x85b c\x85", "\x00a \x00b", "½ x² _a_b", " \n a\n ", "'s 's's"]


def test_cached_ids_equal_whole_ids():
    rng = random.Random(1)
    for name, style in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        coder = CachedEncoder(tokenizer_path(name), style, cached=50)
        texts = ODD + ["".join(rng.choice("abcé ÉÜ.,!\n'1 ") for _ in range(rng.randrange(60))) for _ in range(400)]
        for text in texts + texts:
            assert coder.encode(text) == coder.whole(text), repr(text)
        assert coder.encode(None) == b""


def test_pieces_merge_as_in_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    coder, rng = CachedEncoder(path), random.Random(5)
    assert coder.pairs is not None
    syllables = "ent ion ble and the tion er ing sh ou wh ea ä ö ß é ñ ción ll rr ª µ".split()
    pieces = [rng.choice(["", " "]) + "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + [".", "...", ",;:", "x" * 3000]
    for piece in pieces:
        shown = "".join(map(coder.alphabet.__getitem__, piece.encode()))
        assert coder.pairs.encode_single_piece(piece.encode()) == [t.id for t in coder.model.tokenize(shown)]


def test_plain_texts_are_encoded_in_one_call_and_keep_nothing():
    """Unseen words must not be split, kept and looked up one by one."""
    rng = random.Random(6)
    words = "the of ention thonre Étéñ ß don't we're I'LL 'S 's a|b #1 12,345 x...y ~ <| |> $ (a) \" ' '' 'st 're1 A1b2".split()
    coder = CachedEncoder(tokenizer_path("byte_bpe_50k.json"))
    for _ in range(600):
        lines = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "q"]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 5))]
        text = rng.choice(["", " ", "\n"]) + "\n".join(lines) + rng.choice(["", " ", "\n"])
        assert coder.encode(text) == coder.whole(text), repr(text)
    assert not coder.chunks and not coder.words
    for text in ("a <|endoftext|> b", "a\tb", "a  b", "a\n b", "a\n\nb", "½ a", "a\x85b", "a\x1cb"):  # not plain
        assert coder.encode(text) == coder.whole(text), repr(text)


def test_other_splitters_keep_to_the_library(tmp_path):
    for number, change in enumerate([{"pre_tokenizer": pre_tokenizers.ByteLevel(add_prefix_space=True)}, {"pre_tokenizer": pre_tokenizers.Whitespace()}, {"normalizer": normalizers.Lowercase()}]):
        tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
        for name, value in change.items():
            setattr(tokenizer, name, value)
        path = f"{tmp_path}/{number}.json"
        tokenizer.save(path)
        assert CachedEncoder(path).pairs is None


def test_other_vocabularies_keep_to_the_library(tmp_path):
    """Merges whose order is not that of their ids, or tokens that no merge makes."""
    letters = {c: i for i, c in enumerate(CachedEncoder(tokenizer_path("byte_bpe_50k.json")).alphabet)}
    for number, (more, merges) in enumerate([({"ab": 257, "bc": 256}, [("a", "b"), ("b", "c")]), ({"ab": 256, "xyz": 257}, [("a", "b")])]):
        tokenizer = Tokenizer(models.BPE(letters | more, merges))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        path = f"{tmp_path}/{number}.json"
        tokenizer.save(path)
        coder = CachedEncoder(path)
        assert coder.pairs is None
        for text in ("abc bc xyz", "aabbcc\nabcabc.", ""):
            assert coder.encode(text) == coder.whole(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_against_linear_search(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 32)
    used: list[int] = []
    for length, window, offset in zip(lengths, windows, offsets, strict=True):
        fits = [32 - u for u in used if 32 - u >= length]
        if fits:
            assert 32 - used[window] == min(fits) and offset == used[window]
        else:
            assert window == len(used) and offset == 0
            used.append(0)
        used[window] += length


def whole_ids(text):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_every_id_once_and_gapless(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "cat", "thought", "onwards."]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(100, None, "x", 7), (101, "", "x", 7), (None, "null id", "x", 7), (102, "word " * 30_000, "x", 7), (0, texts[0], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, offset int")
    got = packing.pack_documents(docs, shard_tokens=20_000).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    fill = sum(r["length"] for r in got) / (2048 * len(by_sequence))
    assert fill > 0.9
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids, times = whole_ids(text), 2 if doc_id == 0 else 1
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == times * len(ids)
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == part.tobytes() and zlib.crc32(part.tobytes()) == zlib.crc32(r["ids"])
    assert packing.pack_documents(docs.limit(0)).count() == 0
