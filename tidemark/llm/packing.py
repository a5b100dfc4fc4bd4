"""Packing documents into fixed-length training sequences by best-fit decreasing.

A document's ids (with an end id) are cut into full windows; what is left over is one shorter piece. Pieces are dealt
by hash into shards of about ``shard_tokens`` ids, as many as the corpus needs. Within a shard the pieces are placed
longest first into the open window with the least room that still holds them, found in a segment tree indexed by
remaining room. A shard's result depends on its pieces alone, so a task that runs again gives the same sequences.

Null text counts as empty: the document is then its end id alone. Rows with equal ``doc_id`` are packed one by one.
An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.encoding import encoder, id_width, release_encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = PIECES + ", sequence_id long, offset long"
_BATCH_BYTES = 16 << 20
_SHARDS_A_TASK = 4


class OpenWindows:
    """Open windows by remaining room; ``take(need)`` gives the one with the least room of at least ``need``.

    A segment tree over the rooms 0..capacity counts the windows below each node; a leaf keeps its windows as a stack.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.stacks[room].append(window)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        node, count = need + self.size, self.count
        while not count[node]:  # up until a right neighbour holds a window
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:  # down to its leftmost leaf
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.stacks[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` must not increase."""
    windows, offsets, opened, free = [], [], 0, OpenWindows(capacity)
    for length in lengths:
        found = free.take(length) if length < capacity else None
        window, room = found or (opened, capacity)
        opened += found is None
        windows.append(window)
        offsets.append(capacity - room)
        free.put(window, room - length)
    return windows, offsets


def _tokenize(path: str, style: str, end_id: int, seq_len: int, width: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, window = encoder(path, style, cached), np.array([end_id], dtype="<u4").tobytes(), width * seq_len
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        rows: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = np.frombuffer(coder.encode(text.as_py()) + end, dtype="<u4").astype(f"<u{width}").tobytes()
                total = len(blob) // width
                for at in range(0, len(blob), window):
                    piece = blob[at : at + window]
                    for column, value in zip(rows, (doc_id, at // width, len(piece) // width, total, piece), strict=True):
                        column.append(value)
                held += len(blob)
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = [[], [], [], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def token_pieces(docs: DataFrame, path: str, style: str = "byte", end_id: int = 1, seq_len: int = 2048, width: int | None = None, cached: int = 300_000) -> DataFrame:
    """Every id of every document in exactly one piece of at most ``seq_len`` ids; all but a document's last are full.

    ``ids`` are little-endian of ``width`` bytes, by default as many as the vocabulary's largest id needs. ``cached`` words are kept per worker.
    """
    width = id_width(path, end_id, width=width)
    return base.pick(docs, "doc_id", "text").mapInArrow(_tokenize(path, style, end_id, seq_len, width, cached), PIECES)


def _widened(column: pa.ChunkedArray, width: int) -> pa.Array:
    """Blobs of ``width``-byte ids as blobs of 4-byte ids."""
    blobs = column.combine_chunks()
    offsets = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    ids = np.frombuffer(blobs.buffers()[2], dtype=f"<u{width}")[offsets[0] // width : offsets[-1] // width].astype("<u4")
    wide = ((offsets - offsets[0]) * 4 // width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(blobs), [None, pa.py_buffer(wide.tobytes()), pa.py_buffer(ids.tobytes())])


def _pack(seq_len: int, width: int):
    def run(shard: pa.Table) -> pa.Table:
        release_encoder()  # a reused worker needs no words any more
        number = shard.column("shard")[0].as_py()
        keys = pa.table({"length": shard.column("length"), "doc_id": shard.column("doc_id"), "start": shard.column("start"), "check": shard.column("check")})
        order = pa.compute.sort_indices(keys, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("check", "ascending")])
        shard = shard.take(order)
        windows, offsets = best_fit_decreasing(shard.column("length").to_pylist(), seq_len)
        sequence = np.array(windows, dtype=np.int64) + (number << 24)
        packed = shard.select(["doc_id", "start", "length", "doc_tokens"]).append_column("ids", _widened(shard.column("ids"), width))
        return packed.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(np.array(offsets, dtype=np.int64)))

    return run


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    style: str = "byte",
    end_id: int = 1,
    seq_len: int = 2048,
    shard_tokens: int = 1 << 20,
    width: int | None = None,
    cached: int = 300_000,
) -> DataFrame:
    """Pieces with their ``ids`` (4-byte little-endian), the sequence that holds them and their offset there.

    ``sequence_id`` is the shard's number times 2**24 plus the window's number in it, so a shard may hold up to 2**24
    windows; ``shard_tokens`` keeps it far below. Between the jobs ids take ``width`` bytes (by default what the vocabulary needs),
    in the result 4. Each shard leaves about one window partly filled.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    width = id_width(path, end_id, width=width)
    pieces = base.stage(token_pieces(docs, path, style, end_id, seq_len, width, cached), "token-pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    dealt = pieces.withColumn("check", F.crc32("ids")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "check"), F.lit(shards)))
    tasks = -(-shards // _SHARDS_A_TASK)
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(_pack(seq_len, width), PACKED)
