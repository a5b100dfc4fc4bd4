"""Near-duplicate documents by 64-bit SimHash fingerprints and a binary-trie self-join in Hamming distance.

Fingerprints: lower-case A-Z, take 3-word shingles (repeats count), hash each with XXH64 seed 42; a bit is set if it is
set in over half the hashes. Equal fingerprints are one class, so copies never meet each other in a join.

Join: two fingerprints within ``budget`` bits agree in at least one of ``budget + 1`` blocks of bits, so each class is
dealt to one group for each block's value. A group above ``group_rows`` classes is dealt again by blocks of the bits
that it does not fix yet, and so on: no class is left out and no task gets an unbounded group. Inside a group the
classes form a binary trie (a sorted array; a node is a range). Pairs of nodes are traversed together from the root, the
differing bits on their paths are added up, and a pair is dropped once they exceed the budget. Links become a spanning
forest at once, so a dense group yields fewer edges than members.

Null and empty texts have fingerprint zero and link like any other. Rows with equal ``doc_id`` are separate rows. A null
``doc_id`` keeps its row; it does not name a component unless all of the component are null. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.components import components
from tidemark.llm.encoding import release_encoder

SEED = 42
_WORDS_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 20
_DIRECT = 64


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a whole text as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype=np.uint64)  # noqa: B905
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _WORDS_AT_ONCE):
        block = hashes[at : at + _WORDS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "key", "print"])

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, key, print) for each row: a hash of its text and the fingerprint as a signed long."""
    rows = base.pick(docs, "doc_id", "text").select("doc_id", base.text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(_fingerprints(size), "doc_id long, key long, print long")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def block_masks(bits: list[int], parts: int) -> list[list[int]]:
    """Cut a list of bit numbers into ``parts`` even runs, without empty ones."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair a[i], b[i]; labels stay flat (each points at its root)."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = labels[labels]
            if np.array_equal(flat, labels):
                break
            labels[:] = flat


def trie_links(prints: np.ndarray, groups: np.ndarray, budget: int = 3) -> np.ndarray:
    """Root label of each fingerprint after linking, within each group, all that differ in at most ``budget`` bits.

    ``prints`` are unsigned and sorted within each run of equal ``groups``.
    """
    n = len(prints)
    labels = np.arange(n)
    if n < 2:
        return labels
    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    lo, hi = cut[:-1], cut[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    zero = np.zeros(len(lo), dtype=np.int64)
    work = [(63, lo, hi, lo, hi, zero)]  # next bit, node a, node b, differing bits so far
    ones: dict[int, np.ndarray] = {}
    while work:
        bit, alo, ahi, blo, bhi, differ = work.pop()
        if len(alo) > _PAIRS_AT_ONCE:
            half = len(alo) // 2
            work += [(bit, *(c[s] for c in (alo, ahi, blo, bhi, differ))) for s in (slice(0, half), slice(half, None))]
            continue
        size = (ahi - alo) * (bhi - blo)
        direct = (size <= _DIRECT) if bit >= 0 else np.ones(len(alo), dtype=bool)
        for at in range(0, int(direct.sum()), 1 << 16):
            some = np.flatnonzero(direct)[at : at + (1 << 16)]
            width = np.repeat(bhi[some] - blo[some], size[some])
            inner = np.arange(len(width)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            a = np.repeat(alo[some], size[some]) + inner // width
            b = np.repeat(blo[some], size[some]) + inner % width
            near = (a < b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget)
            merge(labels, a[near], b[near])
        rest = ~direct
        if bit < 0 or not rest.any():
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count = ones[bit]
        alo, ahi, blo, bhi, differ = (c[rest] for c in (alo, ahi, blo, bhi, differ))
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        same = alo == blo
        children = [(alo, amid, blo, bmid, differ), (amid, ahi, bmid, bhi, differ), (alo, amid, bmid, bhi, differ + 1), (amid, ahi, blo, bmid, differ + 1)]
        keep = [np.ones(len(alo), dtype=bool)] * 3 + [~same]
        parts = []
        for (w, x, y, z, d), k in zip(children, keep, strict=True):
            k = k & (x > w) & (z > y) & (d <= budget) & ~((w == y) & (x - w < 2))
            parts.append([c[k] for c in (w, x, y, z, d)])
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(joined[0]):
            work.append((bit - 1, *joined))
    return labels


def _links(budget: int, batch_rows: int):
    def solve(table: pa.Table) -> pa.RecordBatch:
        mask, key, signed = (table.column(i).to_numpy() for i in range(3))
        prints = signed.view(np.uint64)
        order = np.lexsort((prints, key, mask))
        mask, key, prints, signed = mask[order], key[order], prints[order], signed[order]
        groups = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        labels = trie_links(prints, groups, budget)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[labels[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by mask and key: cut only where a group ends
            if sum(b.num_rows for b in held) + batch.num_rows > batch_rows and held:
                table = pa.Table.from_batches(held)
                mask, key = table.column(0).to_numpy(), table.column(1).to_numpy()
                within = (mask == mask[-1]) & (key == key[-1])
                cut = int(np.argmax(within))
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
            held.append(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def trie_self_join(classes: DataFrame, budget: int = 3, group_rows: int = 20_000, batch_rows: int = 100_000) -> DataFrame:
    """Edges (u, v) that connect all ``print`` values within ``budget`` bits; at most one for each class and group."""
    level = [block for block in block_masks(list(range(64)), budget + 1)]
    masks = F.array(*[F.lit(_signed(b)).cast("long") for b in level])
    work = classes.select("print", F.explode(masks).alias("mask"))
    found = None
    while True:
        dealt = work.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("key"), "print")
        large = base.stage(dealt.groupBy("mask", "key").count().where(F.col("count") > group_rows).select("mask", "key"), "large-groups")
        some_large = not large.isEmpty()
        small = dealt.join(large, ["mask", "key"], "left_anti") if some_large else dealt
        edges = small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_links(budget, batch_rows), "u long, v long")
        found = edges if found is None else found.union(edges)
        if not some_large:
            return found
        free = [[b for b in range(64) if b not in set(fixed)] for fixed in level]
        finer = [[sorted(fixed + part) for part in block_masks(rest, budget + 1)] for fixed, rest in zip(level, free, strict=True)]
        children = F.create_map(*[x for fixed, kids in zip(level, finer, strict=True) for x in (F.lit(_signed(fixed)).cast("long"), F.array(*[F.lit(_signed(k)).cast("long") for k in kids]))])
        work = dealt.join(large, ["mask", "key"], "left_semi").select("print", F.explode(children[F.col("mask")]).alias("mask")).distinct()
        level = [list(k) for k in dict.fromkeys(tuple(k) for kids in finer for k in kids)]


def near_duplicates(docs: DataFrame, budget: int = 3, size: int = 3, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, key, print, root, component_id) for each row.

    ``root`` is the component's least fingerprint, ``component_id`` the smallest doc_id that links reach.
    """
    rows = base.stage(fingerprints(docs, size), "fingerprints")
    classes = base.stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(trie_self_join(classes, budget, group_rows)).withColumnRenamed("u", "print")
    rooted = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = base.stage(rooted.join(least, "root").select("print", "root", "component_id"), "fingerprint-components")
    return rows.join(named, "print").select("doc_id", "key", "print", "root", "component_id")
