"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of its labelled text. A text is parsed greedily: each
phrase is the longest run of symbols that occurs in the language's sample, then a new phrase begins. A text in the
sample's language needs few, long phrases. The phrase count times log2 of the sample's length, per symbol, estimates the
cross entropy in bits (Ziv and Merhav), so languages with samples of different length compare; the lowest wins, ties go
to the name that sorts first.

Texts are lower-cased; runs of anything but letters become one space; letters that no sample holds are one symbol. Whole
texts are parsed, in blocks of ``BLOCK`` symbols that all languages share, so that one numpy step moves many blocks of
many texts at once.

Training takes, for each language, the row of least hash in each of ``slots`` hash slots and ``doc_chars``
letters from the middle of each: a stated bound. The rows are chosen from narrow columns first, then their texts are
read.

A null text, or one without a letter, has language "und" and score 0. Rows with a null label are not learned from. With
no labelled row every text is "und". Rows are predicted one by one, repeated ones alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import base
from tidemark.llm.encoding import release_encoder

BLOCK = 256
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_STEPS = 1 << 14
_CHARS = 1 << 20


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton: state x symbol, -1 where the run does not occur. State 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(moves), alphabet), -1, dtype=np.int32)
    for state, found in enumerate(moves):
        for c, to in found.items():
            table[state, c] = to
    return table


@dataclass
class Model:
    """Automata of all languages in one table; ``symbols`` maps code points, anything else is the last symbol."""

    languages: list[str]
    letters: str
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    _lookup: np.ndarray | None = None

    @classmethod
    def train(cls, texts: dict[str, list[str]]) -> Model:
        samples = {lang: " ".join(filter(None, map(normalise, found))) for lang, found in sorted(texts.items())}
        letters = "".join(sorted(set("".join(samples.values())) | {" "}))
        symbol = {c: i for i, c in enumerate(letters)}
        tables, starts, at = [], [], 0
        for sample in samples.values():
            table = suffix_automaton([symbol[c] for c in sample], len(letters) + 1)
            tables.append(np.where(table >= 0, table + at, -1))
            starts.append(at)
            at += len(table)
        joined = np.concatenate(tables) if tables else np.zeros((0, 1), dtype=np.int32)
        bits = np.array([np.log2(len(s) + 2) for s in samples.values()])
        return cls(list(samples), letters, joined.astype(np.int32), np.array(starts, dtype=np.int64), bits)

    def lookup(self) -> np.ndarray:
        """Symbol of each code point."""
        if self._lookup is None:
            self._lookup = np.full(0x110000, self.table.shape[1] - 1, dtype=np.int32)
            self._lookup[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        return self._lookup

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each normalised text under each language."""
        width = self.table.shape[1]
        flat, counts = self.table.reshape(-1), np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        codes = self.lookup()[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        firsts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = firsts[owner] + inner * BLOCK
        span = np.minimum(BLOCK, sizes[owner] - inner * BLOCK)
        order = np.argsort(-span, kind="stable")
        owner, begin, span = owner[order], begin[order], span[order]
        start_moves = flat[(self.starts * width)[:, None] + np.arange(width)[None, :]]  # language x symbol
        for at in range(0, len(owner), _STEPS):
            own, first, left = owner[at : at + _STEPS], begin[at : at + _STEPS], span[at : at + _STEPS]
            state = np.full((len(self.languages), len(own)), -1, dtype=np.int64)
            found = np.zeros_like(state)
            live = len(own)
            for step in range(int(left[0]) if len(left) else 0):
                live = int(np.searchsorted(-left, -step, side="left"))  # blocks longer than step come first
                symbol = codes[first[:live] + step]
                here = state[:, :live]
                moved = flat[np.where(here >= 0, here, 0) * width + symbol]
                moved = np.where(here >= 0, moved, -1)
                stuck = moved < 0  # a phrase ends: the symbol begins the next one
                found[:, :live] += stuck
                state[:, :live] = np.where(stuck, start_moves[:, symbol], moved)
            np.add.at(counts, own, found.T)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how far it leads: 1 - bits of the best / bits of the second."""
        plain = [normalise(t) if t else "" for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.phrases(plain) * self.bits[None, :]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
        else:  # one language alone: against a symbol for each phrase
            second = np.array([len(p) for p in plain]) * self.bits[0]
        score = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0.0).clip(0, 1)
        empty = np.array([not any(map(str.isalpha, p)) for p in plain], dtype=bool)
        return [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best, strict=True)], np.where(empty, 0.0, score)


def train(docs: DataFrame, slots: int = 64, doc_chars: int = 256, learn: Column | None = None) -> Model:
    """Fit on labelled rows (``lang`` not null) that meet ``learn`` (on doc_id, text, lang); all by default.

    At most ``slots`` rows of each language and ``doc_chars`` letters of each row are used. The rows that reach the
    driver number at most languages times slots.
    """
    rows = base.pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    if learn is not None:
        rows = rows.where(learn)
    place = F.xxhash64("doc_id", "lang", F.length("text"))
    keyed = rows.select("text", "lang", place.alias("place"), F.pmod(F.shiftright(place, 20), F.lit(slots)).alias("slot"))
    chosen = keyed.groupBy("lang", "slot").agg(F.min("place").alias("place"))
    middle = F.greatest(F.lit(1), ((F.length("text") - doc_chars) / 2).cast("int"))
    picked = keyed.join(F.broadcast(chosen), ["lang", "slot", "place"]).select("lang", "slot", F.substring("text", middle, F.lit(doc_chars)).alias("text"))
    texts: dict[str, dict] = {}
    for lang, slot, text in picked.groupBy("lang", "slot").agg(F.min("text").alias("text")).orderBy("lang", "slot").collect():
        texts.setdefault(lang, {})[slot] = text
    return Model.train({lang: list(found.values()) for lang, found in texts.items()})


def _predicted(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores of a batch, whole texts at a time, about ``_CHARS`` characters together."""
    release_encoder()
    languages, scores, texts, held = [], [], [], 0
    for i, text in enumerate(column):
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held > _CHARS or i == len(column) - 1:
            named, score = model.predict(texts)
            languages += named
            scores.append(score)
            texts, held = [], 0
    return languages, np.concatenate(scores or [np.zeros(0)])


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = _predicted(batch.column(1), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "key", "lang_pred", "score"])

    return run


def decided(texts: Column, model: Model) -> Column:
    """Whether a text has a language ahead of the others; false for a null text or one without a letter.

    A model that learned no letter tells no languages apart: then every text with a letter counts.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)  # bounded by languages, slots and doc_chars

    def ahead(column: pa.Array) -> pa.Array:
        if not shared.value.letters.strip():
            return pa.array([any(map(str.isalpha, t.as_py() or "")) for t in column], pa.bool_())
        names, scores = _predicted(column, shared.value)
        return pa.array([n != UNKNOWN and s > 0 for n, s in zip(names, scores, strict=True)], pa.bool_())

    return F.arrow_udf(ahead, T.BooleanType())(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, key, lang_pred, score) of each row; ``key`` is a hash of the text."""
    rows = base.pick(docs, "doc_id", "text").select("doc_id", "text", base.text_key(F.col("text")).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages, slots and doc_chars
    return rows.mapInArrow(_predictor(shared), "doc_id long, key long, lang_pred string, score double")
