"""Ranked lexical search of whole corpora: for each item the documents with the highest integer term scores.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents that hold a
term, L terms in all of them, n in one document and df documents with a given term, a term weighs w = floor(1000 ln((2N+2)/(2df+1))),
a document has m = 50 + (50 n N) div L, and its score is the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the item's terms.

Method: bag deduplication. A document is restricted to the items' vocabulary: its vector holds term numbers and counts. Score and
rank depend on vector and m alone, so documents are grouped into classes of equal (hash, m, vector); the vector is part of the key, so
equal hashes of different vectors are told apart. Each class is scored once for all items, in numpy on sparse rows, and every task keeps
each item's best ``top`` classes by (score, smallest doc_id). That is enough: a class outside an item's first ``top`` has as many documents
ahead of it. Only the classes that are left are expanded into members, ``top`` of the smallest doc_ids each.

A corpus of copies is thus one class with a count, made by a combining aggregation; its members are cut by a group limit before
they are moved. Items are ranked in two steps, first in salted parts. The items' terms travel with the tasks: items are dealt into blocks of about
``block_terms`` (item, term) pairs and the corpus is read once for each block, so what travels is bounded for any number of items.

Null text has no terms. Texts of any length are counted in slices cut between terms. Rows that share a doc_id are documents of
their own, and equal scores follow doc_id, a null one last. Items that share an item_id are one item; items without terms have no rows.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

#: A term once A-Z are lower-cased, in UTF-8: all bytes beyond ASCII belong to characters beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_APART = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_SLICE = 1 << 20
_EXPANDED = 1 << 22
_SALTS = 32


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their counts."""
    if len(text) <= _SLICE:
        return Counter(_TERM.findall(text.lower()))
    counts, at = Counter(), 0
    while at < len(text):
        cut = _APART.search(text, at + _SLICE)
        end = cut.start() if cut else len(text)
        counts.update(_TERM.findall(text[at:end].lower()))
        at = end
    return counts


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        yield key, text.as_py() or b""


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(key, term) for key, text in _texts(batch) for term in term_counts(text)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], ["item_id", "term"])


def _vectors(terms: list[bytes]):
    """(doc_id, n, vec) of each row: all its terms counted, and the numbers, then the counts, of those in ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            keys, sizes, vectors = [], [], []
            for key, text in _texts(batch):
                counts = term_counts(text)
                known = sorted((number[t], n) for t, n in counts.items() if t in number)
                keys.append(key)
                sizes.append(counts.total())
                vectors.append(np.array(known, dtype="<u4").T.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())], ["doc_id", "n", "vec"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, counts and row numbers of all entries of a column of vectors."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    cells = np.frombuffer(column.buffers()[2] or b"", dtype="<u4", count=int(bounds[-1]))
    sizes = np.diff(bounds) // 2
    rows = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1], sizes)
    return cells[at].astype(np.int64), cells[at + np.repeat(sizes, sizes)].astype(np.int64), rows


def _document_counts(n_terms: int):
    """(term, df) over a task's classes (vec, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            ids, _, rows = _flat(batch.column(0))
            np.add.at(total, ids, batch.column(1).to_numpy()[rows])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "df"])

    return run


class _Best:
    """An item's best classes so far: rows of (score, first, batch columns), by falling score, then rising first."""

    def __init__(self, top: int, width: int) -> None:
        self.top, self.rows, self.least = top, np.empty((width, 0), dtype=np.int64), 1

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows], axis=1)
        self.rows = rows[:, np.lexsort((rows[1], -rows[0]))[: self.top]]
        if self.rows.shape[1] == self.top:
            self.least = int(self.rows[0, -1])


_LAST = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last
_CLASS = "h long, m long, twin long"


def _best_classes(weights: np.ndarray, starts: np.ndarray, postings: np.ndarray, n_items: int, top: int):
    """(item, score, first, h, m, twin) of each item's best classes in a task; ``postings`` are the items of each term."""
    lengths = np.diff(starts)
    # sums of whole numbers in doubles are exact below 2**53; a term adds less than 2**36
    exact = n_items and np.bincount(postings, minlength=1).max(initial=0) < 1 << 16

    def scores(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        times = lengths[ids]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[ids], times)
        cell = np.repeat(rows * n_items, times) + postings[at]
        if exact:
            return np.bincount(cell, weights=np.repeat(values, times), minlength=n * n_items).astype(np.int64).reshape(n, n_items)
        total = np.zeros(n * n_items, dtype=np.int64)
        np.add.at(total, cell, np.repeat(values, times))
        return total.reshape(n, n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top, 5) for _ in range(n_items)]
        for batch in batches:
            vec, m = batch.column(0), batch.column(2).to_numpy()
            names = np.stack([batch.column(4).fill_null(_LAST).to_numpy(), *[batch.column(i).to_numpy() for i in (1, 2, 3)]])
            ids, tf, rows = _flat(vec)
            values = weights[ids] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
            work = np.maximum(np.bincount(rows, weights=lengths[ids], minlength=len(vec)).astype(np.int64), n_items)
            part = (np.cumsum(work) - work) // _EXPANDED  # rows of one part expand to about as many cells
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for low, high in zip(edges, [*edges[1:], len(vec)], strict=True):
                a, b = np.searchsorted(rows, (low, high))
                found = scores(rows[a:b] - low, ids[a:b], values[a:b], high - low)
                where, item = np.nonzero(found >= np.array([x.least for x in best]))
                order = np.argsort(item, kind="stable")
                where, item = where[order], item[order]
                cuts = np.flatnonzero(np.diff(item, prepend=-1))
                for start, end in zip(cuts, [*cuts[1:], len(item)], strict=True):
                    k = item[start]
                    best[k].add(np.concatenate([found[where[start:end], k][None], names[:, where[start:end] + low]]))
        if any(x.rows.shape[1] for x in best):
            items = np.repeat(np.arange(n_items), [x.rows.shape[1] for x in best])
            rows = np.concatenate([x.rows for x in best], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (items, *rows)], ["item", "score", "first", "h", "m", "twin"])

    return run


def class_hash(vec: str, m: str):
    return F.xxhash64(vec, m)


def _first(df: DataFrame, top: int, keys: list[str], order: list) -> DataFrame:
    """The first ``top`` rows of each key with their ``place``."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col("place") <= top)


def _classes(vectors: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, m, vec) that hold a term of the vocabulary, and their classes (vec, h, m, twin, first, size)."""
    known = vectors.where("length(vec) > 0").withColumn("m", F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L"))
    known = known.select("doc_id", class_hash("vec", "m").alias("h"), "m", "vec")
    classes = base.stage(known.groupBy("h", "m", "vec").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "bag-classes")
    shared = base.stage(classes.groupBy("h", "m").count().where("count > 1"), "bag-collisions")
    if shared.isEmpty():
        return known.withColumn("twin", F.lit(0).cast("long")), classes.withColumn("twin", F.lit(0).cast("long"))
    twins = classes.join(shared, ["h", "m"], "left_semi").select("h", "m", "vec", F.row_number().over(Window.partitionBy("h", "m").orderBy("vec")).cast("long").alias("twin"))
    numbered = lambda df: df.join(base.stage(twins, "bag-twins"), ["h", "m", "vec"], "left").na.fill(0, ["twin"])
    return numbered(known), numbered(classes)


def _search_block(docs: DataFrame, pairs: list, top: int) -> DataFrame | None:
    """(item_id, doc_id, score, rank) for the items of (item_id, term) ``pairs``."""
    terms, items = sorted({t for _, t in pairs}), sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    number, place = {t: k for k, t in enumerate(terms)}, {i: k for k, i in enumerate(items)}
    held = np.array(sorted((number[t], place[i]) for i, t in pairs), dtype=np.int64).reshape(-1, 2)
    starts = np.searchsorted(held[:, 0], np.arange(len(terms) + 1))

    vectors = base.stage(docs.mapInArrow(_vectors(terms), "doc_id long, n long, vec binary"), "bag-vectors")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms:
        return None
    known, classes = _classes(vectors, n_docs, n_terms)
    counted = classes.select("vec", "size").mapInArrow(_document_counts(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(terms), dtype=np.int64)
    for term, n in counted.collect():  # at most the block's terms
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)

    scoring = _best_classes(weights, starts, held[:, 1].copy(), len(items), top)
    scored = classes.select("vec", "h", "m", "twin", "first").mapInArrow(scoring, f"item long, score long, first long, {_CLASS}")
    ranked = [F.desc("score"), F.asc("first"), "h", "m", "twin"]
    salted = _first(scored.withColumn("salt", F.pmod(F.hash("h", "m", "twin"), F.lit(_SALTS))), top, ["item", "salt"], ranked).drop("place")
    best = base.stage(_first(salted, top, ["item"], ranked).select("item", "score", "h", "m", "twin"), "bag-best")

    chosen = best.select("h", "m", "twin").distinct()
    members = known.select("doc_id", "h", "m", "twin").join(F.broadcast(chosen) if top * len(items) <= 1 << 18 else chosen, ["h", "m", "twin"])
    few = _first(members, top, ["h", "m", "twin"], [F.asc_nulls_last("doc_id")]).drop("place")
    whole = _first(best.join(few, ["h", "m", "twin"]), top, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")])
    names = docs.sparkSession.createDataFrame(list(enumerate(items)), "item long, item_id long")
    return whole.join(names, "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``top`` highest-scoring documents with a score above 0."""
    docs = base.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = base.pick(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    pairs = base.stage(wanted.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    blocks = -(-pairs.count() // block_terms)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = [_search_block(docs, [tuple(r) for r in pairs.where(block == b).collect()], top) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


_TERMS_SQL = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: The op12 query in DuckDB SQL, without classes.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
counted AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM counted),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM counted) GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals WHERE term IN (SELECT term FROM items) GROUP BY term),
sized AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM counted, totals),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (r) GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
