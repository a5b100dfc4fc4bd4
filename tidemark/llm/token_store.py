"""Token ids in binary shard files with Elias-Fano coded document boundaries.

A shard file holds the ids of consecutive documents (ascending ``doc_id``) as one array, then the documents' end
offsets as an Elias-Fano list, their ids as another, and a footer. Elias-Fano keeps n ascending values below u in about
n * (2 + log2(u / n)) bits: the low bits of each value packed side by side, the high bits in unary in a bit vector. A
sample of the places of set bits lets ``select`` find any document's offset without a 64-bit table.

Writing: documents are range-partitioned by ``doc_id`` and sorted; each task writes its own files (about
``shard_ids`` ids each) under a fresh name, and names them in its result. Only names that reach the stored manifest
count, so a task that runs twice leaves an unused file at most.

Null text counts as empty: the document is its end id alone. Null doc_ids come first. Rows with equal ``doc_id`` are
separate documents, ordered by a hash of their text. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.encoding import encoder, id_width, tokenizer_path

MAGIC = b"TMTOK1\0\0"
MANIFEST = "file string, part int, number int, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"
_SAMPLE = 256
_DOCS_A_BATCH = 2048


class EliasFano:
    """A compressed list of ascending non-negative integers with random access."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")
        self._low, self._high, self._samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        top = int(values[-1]) + 1
        low_bits = max(0, (top // n).bit_length() - 1)
        shift = np.uint64(low_bits)
        places = (values >> shift).astype(np.int64) + np.arange(n, dtype=np.int64)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        columns = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(columns.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), places[::_SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, read from a few bytes around its sampled place."""
        place = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7))
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        last = first + self.low_bits
        packed = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return ((place - i) << self.low_bits) | ((packed >> (first & 7)) & ((1 << self.low_bits) - 1))

    def block(self, start: int, stop: int) -> np.ndarray:
        """The values ``start`` to ``stop`` - 1, from the bits after the sample before them."""
        first = start // _SAMPLE * _SAMPLE
        if stop <= start:
            return np.zeros(0, dtype=np.int64)
        place, after = int(self.samples[first // _SAMPLE]), -(-stop // _SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[place >> 3 : (end + 7) >> 3], bitorder="little")[place & 7 :]
        places = place + np.flatnonzero(bits)[: stop - first].astype(np.int64)
        packed = self.low[first * self.low_bits >> 3 :]  # a sample's values fill whole bytes
        low_bits = np.unpackbits(packed[: ((stop - first) * self.low_bits + 7) >> 3], count=(stop - first) * self.low_bits, bitorder="little")
        low = (low_bits.reshape(stop - first, self.low_bits).astype(np.int64) << np.arange(self.low_bits, dtype=np.int64)[None, :]).sum(axis=1)
        return (((places - np.arange(first, stop)) << self.low_bits) | low)[start - first :]

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self._low), len(self._high), len(self._samples))
        return head + self._low + self._high + self._samples

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", blob)
        at = struct.calcsize("<QBQQQ")
        return cls(n, low_bits, blob[at : at + a], blob[at + a : at + a + b], blob[at + a + b : at + a + b + c])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams the ids of ascending documents into one file; boundaries and footer follow at the end."""

    def __init__(self, folder: str, width: int) -> None:
        self.uri, self.width = f"{folder}/{uuid.uuid4().hex}.tok", width
        system, path = _open(self.uri)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.keys: list[int] = []
        self.ends: list[int] = []
        self.nulls = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.total += len(ids)
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.keys.append(doc_id)

    def close(self) -> tuple:
        first = self.keys[0] if self.keys else 0
        ends = EliasFano.encode(np.array(self.ends, dtype=np.uint64)).to_bytes()
        keys = EliasFano.encode(np.array([k - first for k in self.keys], dtype=np.uint64)).to_bytes()
        foot = json.dumps({"width": self.width, "ids": self.total, "docs": len(self.ends), "nulls": self.nulls, "first": first, "ends": len(ends), "keys": len(keys)}).encode()
        self.out.write(ends + keys + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        return self.uri, len(self.ends), self.total


class Shard:
    """A shard file read back: document ``i`` has the ids ``offset(i):offset(i + 1)``."""

    def __init__(self, uri: str) -> None:
        system, path = _open(uri)
        with system.open_input_file(path) as f:
            blob = f.read()
        if blob[:8] != MAGIC or blob[-8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token shard")
        (size,) = struct.unpack("<I", blob[-12:-8])
        foot = json.loads(blob[-12 - size : -12])
        self.width, self.n_docs, self.nulls, self.first = foot["width"], foot["docs"], foot["nulls"], foot["first"]
        at = 8 + foot["ids"] * self.width
        self.ids = np.frombuffer(blob, dtype=f"<u{self.width}", count=foot["ids"], offset=8)
        self.ends = EliasFano.from_bytes(blob[at : at + foot["ends"]])
        self.keys = EliasFano.from_bytes(blob[at + foot["ends"] : at + foot["ends"] + foot["keys"]])

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.offset(i + 1)]


def _write(path: str, style: str, end_id: int, folder: str, width: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path, style), np.array([end_id], dtype="<u4")
        part, rows, writer = TaskContext.get().partitionId(), [], None

        def finish() -> None:
            uri, n_docs, n_ids = writer.close()
            rows.append((uri, part, len(rows), n_docs, n_ids))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or ShardWriter(folder, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(coder.encode(text.as_py()), dtype="<u4"), end]))
                if writer.total >= shard_ids:
                    finish()
                    writer = None
        if writer:
            finish()
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "part", "number", "n_docs", "n_ids"])

    return run


def write_token_store(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    style: str = "word",
    end_id: int = 2,
    width: int | None = None,
    shard_ids: int = 1 << 24,
) -> DataFrame:
    """Write all documents and return the stored manifest, one row per file.

    ``folder`` is one that all executors share (by default the session's own under spark.checkpoint.dir). ``width`` is the bytes of an
    id, by default what the vocabulary's largest id needs.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    width = id_width(path, end_id, width=width)
    folder = folder or f"{base.run_folder(spark)}/tokens-{uuid.uuid4().hex}"
    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    keyed = base.pick(docs, "doc_id", "text").withColumn("key", base.text_key(F.col("text")))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("key")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "key")
    return base.stage(ordered.mapInArrow(_write(path, style, end_id, folder, width, shard_ids), MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(uri)
            for at in range(0, shard.n_docs, _DOCS_A_BATCH):
                stop = min(at + _DOCS_A_BATCH, shard.n_docs)
                ends = shard.ends.block(at, stop)
                starts = np.concatenate([[shard.offset(at)], ends[:-1]])
                nulls = max(0, min(shard.nulls, stop) - at)
                keys = [None] * nulls + (shard.first + shard.keys.block(at + nulls - shard.nulls, stop - shard.nulls)).tolist()
                blobs = [shard.ids[x:y].astype("<u4").tobytes() for x, y in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(blobs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read_token_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document from the files: its first id's place among all ids, its length and its ids (4-byte blobs).

    The running total over files is one small window: a manifest has one row for each ``shard_ids`` ids.
    """
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(_read, DOCS)
