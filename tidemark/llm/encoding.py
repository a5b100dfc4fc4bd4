"""Exact token ids of whole texts from a `tokenizers` file, with repeated words encoded once per worker.

Byte-pair merges never cross the pieces that a tokenizer's own splitter makes, and both supported splitters cut
between a word and the white space before the next. A text can therefore be encoded chunk by chunk, and a chunk's
ids kept for its next occurrence. Texts in which that cut could be wrong are encoded whole. Plain byte-level texts
(``_ODD`` and ``_DOUBLED`` not found) are split and merged in one call instead, which keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_STEM = re.compile(f"( ?)([{_LETTERS}]+)([.,;:!?]*)")
_CHUNK = re.compile(r"\s*\S+|\s+")
_DOUBLE = re.compile(r"\s\s")
_CONTROL = re.compile(r"[\x1c-\x1f]")
#: What a plain text lacks: all but letters of ``_LETTERS``, printable ASCII and line ends; white space next to white space.
_ODD = re.compile("[^\n -~À-ÖØ-öø-ÿ]")
_DOUBLED = ("  ", "\n\n", "\n ", " \n")
#: The byte-level splitter without its look ahead, which only matters where white space follows white space.
_PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _pair_merger(path: str):
    """A faster splitter and merger of byte pairs over a tokenizer file's own vocabulary; none where it could give other ids.

    It merges the pair whose product has the smallest id first, so the file's merges must be in the order of their products' ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    model, splitter = parts["model"], parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return None
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False}
    byte_of = {c: b for b, c in _byte_alphabet().items()}
    if model.get("type") != "BPE" or any(model.get(k) not in (v, None, "") for k, v in plain.items()) or any(set(t) - byte_of.keys() for t in model["vocab"]):
        return None
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    letters = [model["vocab"].get(c) for c in byte_of]
    # every token is a byte or the product of one merge
    if None in made or None in letters or any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(model["vocab"]) != len(made) + 256:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
    return tiktoken.Encoding("pieces", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})._core_bpe


def _packed(ids: list[int]) -> bytes:
    """Little-endian 4-byte blob."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _keep(cache: dict[str, bytes], most: int, key: str, value: bytes) -> None:
    """Add to a cache; a full one gives up the half that was added first."""
    if len(cache) >= most:
        for old in list(islice(cache, most // 2)):
            del cache[old]
    cache[key] = value


class CachedEncoder:
    """Token ids as little-endian 4-byte blobs.

    ``style`` is "byte" for byte-level vocabularies whose words carry the space before them, "word" for those that
    lower the case and drop white space. At most ``cached`` words and as many chunks are kept.
    """

    def __init__(self, path: str, style: str = "byte", cached: int = 400_000) -> None:
        from tokenizers import Tokenizer

        if style not in ("byte", "word"):
            raise ValueError("style is byte or word")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.style, self.cached = style, cached
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        alphabet = _byte_alphabet()
        self.alphabet = [alphabet[b] for b in range(256)]
        self.pairs = _pair_merger(path) if style == "byte" else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _word(self, piece: str) -> bytes:
        """Ids of one piece of the splitter: letters with at most one space before, or a run of marks."""
        found = self.words.get(piece)
        if found is None:
            if self.pairs is not None:
                found = _packed(self.pairs.encode_single_piece(piece.encode()))
            else:
                if piece.isascii():  # printable ones but for the space, which the pattern of a word lets in
                    shown = piece.replace(" ", self.alphabet[32])
                else:
                    shown = "".join(map(self.alphabet.__getitem__, piece.encode()))
                found = _packed([t.id for t in self.model.tokenize(shown)])
            _keep(self.words, self.cached, piece, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        stem = _STEM.fullmatch(chunk)
        if stem is None:
            found = self.whole(chunk)
        else:
            space, letters, marks = stem.groups()
            found = self._word(space + letters if self.style == "byte" else letters.lower())
            if marks:
                found += self._word(marks)
        _keep(self.chunks, self.cached, chunk, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """All ids of the whole text; empty for a null or empty one."""
        if not text:
            return b""
        if self.pairs is not None and not _ODD.search(text) and not any(map(text.__contains__, _DOUBLED)) and not any(map(text.__contains__, self.added)):
            return np.frombuffer(self.pairs.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32).astype("<u4").tobytes()
        if _CONTROL.search(text):
            return self.whole(text)
        if self.style == "word":
            chunks = text.split()
        elif _DOUBLE.search(text):
            chunks = _CHUNK.findall(text)
        else:  # every white-space character stands alone: a space leads its word, a line end is a piece of its own
            chunks = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in text else _CHUNK.findall(text)
        known = self.chunks
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            get = known.get
            return b"".join([found if (found := get(c)) is not None else self._chunk(c) if c else b"" for c in chunks])


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, style: str, cached: int = 400_000) -> CachedEncoder:
    """The worker process's encoder, kept between tasks of one operator; asking for another gives this one back."""
    key = (path, style, cached)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(path, style, cached)
    return _ENCODERS[key]


def id_width(path: str, *more: int, width: int | None = None) -> int:
    """Bytes that hold every id of a vocabulary and the ids in ``more``: 2 or 4. A given ``width`` must do so."""
    from tokenizers import Tokenizer

    largest = max([*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), *more])
    needed = 2 if largest < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < needed):
        raise ValueError(f"ids up to {largest} do not fit into {width} bytes")
    return width or needed


def release_encoder() -> None:
    """Give the kept words back, where a reused worker goes on with another operator."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
