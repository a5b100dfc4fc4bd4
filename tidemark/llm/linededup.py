"""Exact and near duplicate lines across a corpus, by a join of deletion neighbourhoods; the earliest line stays.

A line is its words (runs of non-space) in order. The edit distance counts words inserted, deleted or replaced, and the
bound is one edit. The deletion neighbourhood of a line is the line itself and each line that lacks one of its words.
Two lines are within the bound only if they share a member: at the same deleted place (a replaced word), or one line
whole and the other short of a word. So members are emitted as 128-bit hashed keys, equal keys joined, and the edit
distance verified on the words.

A line goes if an earlier line (by doc_id, then text hash, then place) equals it or, for lines of at least ``min_words``
words, is within the bound. The decision looks at all earlier lines, whether or not they stay.

Equal lines are first made one class, so copies never meet. Most lines have no near line; to spare their neighbourhoods,
a line emits only if its first or its last words are shared by a different line. That test loses nothing: two lines
within one edit agree in at least (longer - 1) words from the front and the back together, hence in half of them on one
side. The edit then lies past the words of that side, so only members that lack a word there are emitted. Members whose
key no other has are left out before the join. Inside a group of equal keys the earliest member is found by aggregation,
so a group never emits all its pairs.

Null and empty texts stay as they are, like lines without a word. Rows that agree in doc_id and text are treated alike
(all keep the same lines). A null doc_id counts as later than any other. Other columns are carried along unchanged,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import base
from tidemark.llm.encoding import release_encoder

_GRID = 4
_LAST = (1 << 63) - 1
_CHUNK = 1 << 20
_EMIT = 1 << 18
_NO_SIDE = (1 << 31) - 1
#: Of the bytes up to the space, those that part words or lines.
_BLANK = np.array([bytes([c]).isspace() for c in range(33)])

_OTHER_SPACE = re.compile(r"[^\S \t-\r]")

LINES = "doc long, row long, line int, h1 long, h2 long, words int, front long, back long, front2 long, back2 long"
KEYS = "v1 long, v2 long, at int, id long"


def _shared_side(longer):
    """How many first or last words two lines within one edit share, of which the longer has ``longer`` words; rounded down to a grid."""
    return (longer - 1) // (2 * _GRID) * _GRID


def _shared_sides(n: int) -> list[int]:
    """How many first or last words a line of ``n`` words shares with any line within one edit, for the longer of the
    two having n or n + 1 words; rounded down to a grid so that both lines look at the same number."""
    return sorted({_shared_side(longer) for longer in (n, n + 1)})


def _chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """About ``size`` bytes of texts at a time, one text at least, after the place of the first; null ones are empty."""
    texts = texts.cast(pa.binary())
    first, held = 0, 0
    for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist(), 1):
        held += length
        if held >= size or i == len(texts):
            yield first, [t or b"" for t in texts.slice(first, i - first).to_pylist()]
            first, held = i, 0


def _evenly_spaced(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lines of all texts with one space between words and none elsewhere, each between line ends; where those and where the spaces are."""
    while True:
        joined = b"\n".join([b"", *texts, b""])
        chars = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(chars <= 32)
        gaps = gaps[_BLANK[chars[gaps]]]
        kinds = chars[gaps]
        odd = (kinds != 10) & (kinds != 32)
        beside = (np.diff(gaps) == 1) & ((kinds[1:] == 32) | (kinds[:-1] == 32))
        odd[1:] |= beside
        odd[:-1] |= beside
        if not odd.any():
            return joined, gaps[kinds == 10], gaps[kinds == 32]
        ends = np.cumsum([len(t) + 1 for t in texts])
        for i in np.unique(np.searchsorted(ends, gaps[odd])).tolist():
            texts[i] = b"\n".join([b" ".join(x.split()) for x in texts[i].split(b"\n")])


def _digests(found: list[bytes], width: int) -> np.ndarray:
    """Digests as rows of ``width`` signed longs."""
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, width)


def _described(joined: bytes, line_ends: np.ndarray, spaces: np.ndarray, min_words: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Which lines have words; their hashes, numbers of words and hashed sides."""
    import xxhash

    whole, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest
    full = np.flatnonzero(np.diff(line_ends) > 1)
    starts, ends = line_ends[full] + 1, line_ends[full + 1]
    first, after = np.searchsorted(spaces, starts), np.searchsorted(spaces, ends)
    words = after - first + 1
    hashes = _digests([whole(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], 2)
    out = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(words.astype(np.int32))]
    of_same, of_more = _shared_side(words), _shared_side(words + 1)
    for shared, wanted in ((of_same, of_same > 0), (of_more, (of_more > 0) & (of_more != of_same))):
        at = np.flatnonzero(wanted & (words >= min_words))
        k = shared[at]
        fronts = zip(starts[at].tolist(), spaces[first[at] + k - 1].tolist(), k.tolist(), strict=True)
        backs = zip((spaces[after[at] - k] + 1).tolist(), ends[at].tolist(), (~k & 0xFFFFFFFF).tolist(), strict=True)
        for sides in (fronts, backs):
            values, missing = np.zeros(len(words), np.int64), np.ones(len(words), bool)
            values[at], missing[at] = _digests([short(joined[a:b], seed) for a, b, seed in sides], 1)[:, 0], False
            out.append(pa.array(values, mask=missing))
    return full, out


def _lines(min_words: int):
    names = [x.split()[0] for x in LINES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            docs, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, texts in _chunks(batch.column(2), _CHUNK):
                counts = np.array([t.count(b"\n") + 1 for t in texts])
                full, described = _described(*_evenly_spaced(texts), min_words)
                text = np.repeat(np.arange(len(texts)), counts)
                places = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                owner = i + text[full]
                yield pa.RecordBatch.from_arrays([pa.array(docs[owner]), pa.array(rows[owner]), pa.array(places[full].astype(np.int32)), *described], names=names)

    return run


def _multipliers(count: int) -> np.ndarray:
    """Two fixed, random-looking 64-bit numbers for each place of a word (SplitMix64)."""
    z = np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).reshape(-1, 2)


def _hashed_neighbourhoods(lines: list[list[str]] | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit keys, as rows of two longs, of all lines as they are and of each line without each of its words, with that word's line and place.

    A key sums the words' hashes, each times a number of its place, so that running sums give all keys in O(n) steps.
    """
    import xxhash

    codes = _digests([xxhash.xxh3_128_digest(w) for words in lines for w in words], 2).view(np.uint64)
    n = np.array([len(words) for words in lines], np.int64)
    first = np.cumsum(n) - n
    line = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(codes)) - first[line]
    factors, none = _multipliers(int(n.max(initial=0)) + 1), np.zeros((1, 2), np.uint64)
    front = np.concatenate([none, np.cumsum(codes * factors[at], axis=0, dtype=np.uint64)])
    moved = np.concatenate([none, np.cumsum(codes * factors[at - 1], axis=0, dtype=np.uint64)])
    whole = front[first + n] - front[first]
    short = front[:-1] - front[first[line]] + moved[(first + n)[line]] - moved[1:]
    return whole.view(np.int64), short.view(np.int64), line, at


def deletion_keys(words: list[bytes]) -> list[tuple[int, int]]:
    """128-bit keys of a line's deletion neighbourhood: the line itself, then without its first word, and so on."""
    whole, short, _, _ = _hashed_neighbourhoods([words])
    return list(map(tuple, np.concatenate([whole, short]).tolist()))


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of lines (id, text, front, back): the line itself, and without a word that is not among its ``front`` first or not among its ``back`` last words.

    Lines with white space other than ASCII lack each of their words in turn.
    """
    release_encoder()
    for batch in batches:
        ids, fronts, backs = (batch.column(i).fill_null(_NO_SIDE if i else 0).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        for i, texts in _chunks(batch.column(1), _EMIT):
            shown = [t.decode() for t in texts]
            lines = [t.split() for t in shown]
            # sides count words between ASCII spaces
            uncounted = np.array([_OTHER_SPACE.search(t) is not None for t in shown])
            whole, short, line, at = _hashed_neighbourhoods(lines)
            n = np.array([len(words) for words in lines])
            owner = i + line
            chosen = np.flatnonzero(uncounted[line] | (at >= fronts[owner]) | (at < n[line] - backs[owner]))
            keys = np.concatenate([whole, short[chosen]])
            places = np.concatenate([np.full(len(n), -1), at[chosen]]).astype(np.int32)
            of = np.concatenate([ids[i : i + len(n)], ids[owner[chosen]]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[:, 0], keys[:, 1], places, of)], names=["v1", "v2", "at", "id"])


def within_one_edit(a: list, b: list) -> bool:
    """Whether one inserted, deleted or replaced item at most turns ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one_edit(x.as_py().split(), y.as_py().split()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["h1", "h2"]).filter(pa.array(keep, pa.bool_()))


@F.arrow_udf(T.BinaryType())
def _compressed(texts: pa.Array) -> pa.Array:
    import zstandard

    release_encoder()
    packer = zstandard.ZstdCompressor(level=3)
    return pa.array((packer.compress(t.as_buffer()) if t.is_valid else None for t in texts), pa.binary())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _chosen_lines(blobs: pa.Array, places: pa.Array) -> pa.Array:
    """The lines at some places of a compressed text."""
    import zstandard

    reader, out = zstandard.ZstdDecompressor(), []
    for blob, chosen in zip(blobs, places.to_pylist(), strict=True):
        lines = reader.decompress(blob.as_py()).split(b"\n")
        out.append([lines[i].decode() for i in chosen])
    return pa.array(out, pa.list_(pa.string()))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("gone", T.IntegerType()), T.StructField("blank", T.BooleanType())])

@F.arrow_udf(_CUT)
def _without(blobs: pa.Array, places: pa.Array) -> pa.Array:
    """A compressed text without the lines at some places; whether that leaves none of its words."""
    import zstandard

    release_encoder()
    reader, done = zstandard.ZstdDecompressor(), []
    columns: list[list] = [[] for _ in _CUT.names]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.bool_()]

    def made() -> pa.Array:
        text, *rest = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
        return pa.StructArray.from_arrays([text.cast(pa.string()), *rest], names=_CUT.names)

    for blob, gone in zip(blobs, places.to_pylist(), strict=True):
        if len(columns[0]) >= 1000:
            done.append(made())
            columns = [[] for _ in _CUT.names]
        text, lines, drop = None, 0, set(gone or ())
        if blob.is_valid:
            text = reader.decompress(blob.as_buffer())
            lines = text.count(b"\n") + 1
        if blob.is_valid and drop:
            text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in drop])
        for column, value in zip(columns, (text, lines, len(drop) if blob.is_valid else 0, bool(drop) and blob.is_valid and not text.strip()), strict=True):
            column.append(value)
    return pa.concat_arrays([*done, made()])


def _candidates(occurrences: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, front, back): long line classes that share their first ``front`` or last ``back`` words with another; null where they share none there."""
    long_lines = occurrences.where(F.col("words") >= min_words)
    same, more = (F.floor((F.col("words") + i) / (2 * _GRID)).cast("int") * _GRID for i in (-1, 0))  # as _shared_side
    # the number of words, negative for the last ones
    sides = F.array(*[F.struct(F.col(c).alias("side"), k.alias("reach")) for c, k in (("front", same), ("back", -same), ("front2", more), ("back2", -more))])
    sides = long_lines.select("h1", "h2", F.explode(F.filter(sides, lambda x: x.side.isNotNull())).alias("x")).select("h1", "h2", "x.side", "x.reach")
    shared = sides.groupBy("side").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least != most").select("side")
    # of so few words that lines within one edit need not agree on a side
    always = long_lines.where(F.col("words") <= 2 * _GRID).select("h1", "h2", F.lit(0).alias("reach"))
    found = sides.join(shared, "side", "left_semi").select("h1", "h2", "reach").union(always)
    reach = F.col("reach")
    return found.groupBy("h1", "h2").agg(F.min(F.when(reach >= 0, reach)).alias("front"), F.min(F.when(reach < 0, -reach)).alias("back"))


def _near_lines(occurrences: DataFrame, classes: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of line classes with an earlier line within one edit."""
    firsts = classes.join(_candidates(occurrences, min_words), ["h1", "h2"])
    wanted = firsts.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("line", "h1", "h2", "front", "back"))).alias("places"))
    found = texts.join(wanted, ["doc", "row"]).select("doc", "row", "places", _chosen_lines("blob", "places.line").alias("lines"))
    found = found.select("doc", "row", F.explode(F.arrays_zip("places", "lines")).alias("x")).select("doc", "row", "x.places.*", F.col("x.lines").alias("text"))
    # an earlier line has a smaller id
    lines = found.dropDuplicates(["doc", "row", "line"]).orderBy("doc", "row", "line").withColumn("id", F.monotonically_increasing_id())
    lines = base.stage(lines.select("id", "h1", "h2", "front", "back", "text"), "near-candidates")

    keys = base.stage(lines.select("id", "text", "front", "back").mapInArrow(_neighbourhoods, KEYS), "neighbourhoods")
    repeated = keys.groupBy("v1").agg(F.count("*").alias("n")).where("n > 1").select("v1")
    keys = base.stage(keys.join(repeated, "v1", "left_semi"), "shared-keys")
    whole = keys.where("at < 0").select("v1", "v2", F.col("id").alias("partner"))
    short = keys.where("at >= 0")
    least = short.groupBy("v1", "v2", "at").agg(F.min("id").alias("partner"), F.count("*").alias("n")).where("n > 1").drop("n")
    replaced = short.join(least, ["v1", "v2", "at"]).where("partner < id").select("id", "partner")
    inserted = short.join(whole, ["v1", "v2"]).select(F.greatest("id", "partner").alias("id"), F.least("id", "partner").alias("partner"))
    pairs = replaced.union(inserted).distinct()
    both = pairs.join(lines.select("id", "h1", "h2", F.col("text").alias("a")), "id").join(lines.select(F.col("id").alias("partner"), F.col("text").alias("b")), "partner")
    return both.select("h1", "h2", "a", "b").mapInArrow(_verified, "h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_words: int = 5, drop_emptied: bool = False) -> DataFrame:
    """The rows with repeated lines cut from ``text``, and the columns ``line_count`` and ``lines_removed`` added.

    With ``drop_emptied`` rows that lose every word are left out. If the input has ``n_chars``, it follows the text.
    """
    names = docs.columns
    if "doc_id" not in names or "text" not in names:
        raise ValueError("doc_id and text are needed")
    plain = base.positional(docs)
    id_col, text_col = (F.col(f"col_{names.index(n)}") for n in ("doc_id", "text"))
    keyed = plain.withColumns({"doc": F.coalesce(id_col, F.lit(_LAST)), "row": F.coalesce(base.text_key(text_col), F.lit(0))})
    occurrences = base.stage(keyed.select("doc", "row", text_col).mapInArrow(_lines(min_words), LINES), "lines")
    first = F.min(F.struct("doc", "row", "line"))
    classes = occurrences.groupBy("h1", "h2").agg(first.alias("first"), F.count("*").alias("n")).select("h1", "h2", "first.*", "n")
    classes = base.stage(classes, "line-classes")
    texts = keyed.select("doc", "row", _compressed(text_col).alias("blob"))
    near = base.stage(_near_lines(occurrences, classes, texts, min_words).distinct(), "near-lines")

    judged = classes.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", F.struct("doc", "row", "line").alias("first"), "near")
    gone = occurrences.select("h1", "h2", F.struct("doc", "row", "line").alias("place")).join(judged, ["h1", "h2"]).where("near or place != first")
    gone = base.stage(gone.groupBy("place.doc", "place.row").agg(F.collect_set("place.line").alias("places")), "lines-to-cut")
    packed = keyed.withColumn("blob", _compressed(text_col)).drop(f"col_{names.index('text')}")
    # else a filter on the cut would cut a second time, by more workers
    cut = packed.join(gone, ["doc", "row"], "left").withColumn("cut", _without.asNondeterministic()("blob", "places"))
    if drop_emptied:
        cut = cut.where(~F.col("cut.blank"))
    rebuilt = {"text": F.col("cut.text"), "n_chars": F.length("cut.text").cast("long")}
    out = [rebuilt[n] if n in rebuilt and names.index(n) == i else F.col(f"col_{i}") for i, n in enumerate(names)]
    return cut.select(*out, "cut.lines", "cut.gone").toDF(*names, "line_count", "lines_removed")
