"""Approximate nearest neighbours in Euclidean distance by multiprobe p-stable hashing.

Each of ``tables`` hash tables projects vectors on Gaussian directions, shifts and cuts the line into cells of one
width; a vector's cells name its bucket. A query visits, in every table, the ``probes`` buckets around its own that are
likeliest to hold a near vector: stepping one cell costs the squared distance to that cell's border, and the sums over
directions order all perturbations. Candidates of all tables are merged and ranked by the exact distance.

The number of directions and of probes is fitted on ``sample_rows`` vectors (chosen by hash): for each number of
directions, the fewest probes that reach ``target`` recall in the sample, then the cheapest pair for the whole table.
A sample is sparser than the table, so its neighbours are farther and the fit errs on the safe side.

Equal vectors are one class that keeps its k + 1 smallest ids, all that any answer can hold, so copies never meet each
other. Buckets above ``block_rows`` classes are searched in blocks. A query that finds fewer than ``k`` rows is
searched against all rows, in blocks.

Vectors that are null, empty, zero, or hold null or non-finite numbers take no part; a query among them has no rows.
Only vectors of equal dimension meet. Rows that share a vec_id never answer each other. A repeated vec_id with the same vector counts once; a null vec_id is left out. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

_FEW = 64
_SALTS = 1024


@dataclass
class HashFamily:
    """Directions, shifts and perturbations of all tables for one dimension."""

    directions: np.ndarray  # tables x dimension x functions
    shifts: np.ndarray  # tables x functions
    width: float
    steps: np.ndarray  # perturbations x functions
    probes: int

    @classmethod
    def draw(cls, dimension: int, tables: int, functions: int, width: float, probes: int, seed: int) -> HashFamily:
        rng = np.random.default_rng([seed, dimension])
        directions = rng.standard_normal((tables, dimension, 8))[:, :, :functions]
        shifts = rng.random((tables, 8))[:, :functions]
        steps = np.array(list(itertools.product((0, -1, 1), repeat=functions)), dtype=np.int64)
        return cls(directions, shifts, width, steps, probes)

    def cells(self, table: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and the place inside each cell (0 to 1)."""
        at = vectors @ self.directions[table] / self.width + self.shifts[table]
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    @staticmethod
    def bucket(cells: np.ndarray) -> np.ndarray:
        key = np.zeros(cells.shape[:-1], dtype=np.uint64)
        for j in range(cells.shape[-1]):
            key = (key ^ cells[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def costs(self, inside: np.ndarray) -> np.ndarray:
        """Squared distance, in cell widths, to the near corner of each perturbed bucket: low is likely."""
        down, up = inside[:, None, :] ** 2, (1 - inside[:, None, :]) ** 2
        return np.where(self.steps < 0, down, np.where(self.steps > 0, up, 0.0)).sum(axis=2)

    def probed(self, table: int, vectors: np.ndarray) -> np.ndarray:
        """Buckets to visit for each query, likeliest first."""
        cells, inside = self.cells(table, vectors)
        order = np.argsort(self.costs(inside), axis=1, kind="stable")[:, : self.probes]
        return self.bucket(cells[:, None, :] + self.steps[order])


def fit(sample: np.ndarray, rows: int, k: int, tables: int, target: float, seed: int) -> tuple[int, float, int]:
    """(functions, width, probes) from a sample of distinct vectors, for a table of ``rows``."""
    queries = sample[:: max(1, len(sample) // _FEW)]
    squares = (queries**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * queries @ sample.T
    own = np.arange(0, len(sample), max(1, len(sample) // _FEW))
    squares[np.arange(len(own)), own] = np.inf
    finite = squares[np.isfinite(squares)]
    width = float(np.sqrt(max(np.median(finite), 0.0))) if len(finite) else 0.0
    width = width or 1.0
    near = np.argsort(squares, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    best: tuple[float, int, int] | None = None
    for functions in range(1, 8):
        family = HashFamily.draw(sample.shape[1], tables, functions, width, 0, seed)
        place = {tuple(s): i for i, s in enumerate(family.steps.tolist())}
        first = np.full(near.shape, len(family.steps))
        shares = []
        for table in range(tables):
            cells, inside = family.cells(table, sample)
            order = np.argsort(family.costs(inside[own]), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
            step = cells[near] - cells[own][:, None, :]
            for (i, j), _ in np.ndenumerate(near):
                at = place.get(tuple(step[i, j].tolist()))
                if at is not None:
                    first[i, j] = min(first[i, j], rank[i, at])
            step = cells[None, :, :] - cells[own][:, None, :]
            inside_reach = (np.abs(step) <= 1).all(axis=2)
            code = ((step % 3) * (3 ** np.arange(functions - 1, -1, -1))).sum(axis=2)  # (0, -1, 1) -> 0, 2, 1
            lookup = np.array([((s % 3) * (3 ** np.arange(functions - 1, -1, -1))).sum() for s in family.steps])
            back = np.argsort(lookup)
            shares.append(np.where(inside_reach, np.take_along_axis(rank, back[code], axis=1), len(family.steps)))
        reached = np.sort(first.reshape(-1))
        if not len(reached):
            return 1, width, 3
        probes = int(reached[min(len(reached) - 1, int(np.ceil(target * len(reached))) - 1)]) + 1
        if probes > len(family.steps):
            continue
        visited = sum(float((s < probes).mean()) for s in shares)
        cost = visited * rows + 200.0 * tables * probes
        if best is None or cost < best[0]:
            best = (cost, functions, probes)
    return (best[1], width, best[2]) if best else (1, width, 3)


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


ENTRIES = "tab int, bucket long, kind int, id long, vector array<double>"


def _hashed(families: dict[int, HashFamily], kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids = batch.column(0).to_numpy()
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    family, vectors = families[int(size)], np.stack([flat[starts[i] : starts[i + 1]] for i in rows])
                    for table in range(len(family.directions)):
                        buckets = family.bucket(family.cells(table, vectors)[0])[:, None] if kind == 0 else family.probed(table, vectors)
                        buckets = buckets ^ int(size)
                        times = buckets.shape[1]
                        for a in range(0, times, 64):
                            some = buckets[:, a : a + 64]
                            repeated = np.repeat(np.arange(len(rows)), some.shape[1])
                            n = len(repeated)
                            listed = pa.ListArray.from_arrays(np.arange(0, (n + 1) * size, size, dtype=np.int32), vectors[repeated].reshape(-1))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, table, dtype=np.int32)), pa.array(some.reshape(-1)), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(ids[rows][repeated]), listed], names=["tab", "bucket", "kind", "id", "vector"])

    return run


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows: query number, ids and exact distances, ties to smaller ids."""
    if queries.shape[1] != vectors.shape[1]:
        return
    norms = (vectors**2).sum(axis=1)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = norms[None, :] - 2 * block @ vectors.T
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1) + norms.max())
        bound = (np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else rough.max(axis=1)) + slack
        for i in range(len(block)):
            near = np.flatnonzero(rough[i] <= bound[i])
            exact = np.sqrt(((vectors[near] - block[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact))[:k]
            yield at + i, ids[near][order], exact[order]


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    column = pa.Table.from_batches(batches).column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int):
    """Rows arrive by bucket and block, stored vectors before queries; queries stream past the block's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stored, vectors, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, name = batch.slice(a, b - a), tuple(keys[:3, a])
                if name != group:
                    group, stored, vectors = name, [], None
                if keys[3, a] == 0:
                    stored.append(part)
                    continue
                if not stored:
                    continue
                if vectors is None:
                    vectors, ids = _matrix(stored), pa.Table.from_batches(stored).column("id").to_numpy()
                asked, out = part.column(4).to_numpy(), ([], [], [])
                for i, near, distances in nearest(_matrix([part]), ids, vectors, k):
                    out[0].append(np.full(len(near), asked[i]))
                    out[1].append(near)
                    out[2].append(distances)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query", "id", "distance"])

    return run


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    """The k nearest classes of each query class, each once."""
    found = (
        entries.select("tab", "bucket", "block", "kind", "id", "vector")
        .repartition("tab", "bucket", "block")
        .sortWithinPartitions("tab", "bucket", "block", "kind")
        .mapInArrow(_search(k), "query long, id long, distance double")
    )
    order = Window.partitionBy("query").orderBy("distance", "id")
    once = found.groupBy("query", "id").agg(F.min("distance").alias("distance"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _in_blocks(stored: DataFrame, asked: DataFrame, block_rows: int) -> DataFrame:
    """Cut large buckets into blocks of stored rows; a query of such a bucket goes to every block."""
    large = stored.groupBy("tab", "bucket").count().where(F.col("count") > block_rows).select("tab", "bucket", F.ceil(F.col("count") / block_rows).cast("long").alias("blocks"))
    large = base.stage(large, "large-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = stored.join(large, ["tab", "bucket"], "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("blocks")
    spread = asked.join(large, ["tab", "bucket"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")
    return placed.unionByName(spread)


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 4,
    target: float = 0.96,
    sample_rows: int = 4096,
    block_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other rows of each row that meets ``queries`` (on ``id``)."""
    keep = k + 1
    rows = base.pick(vectors, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    salted = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    classes = salted.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    classes = base.stage(classes.withColumn("id", F.col("ids")[0]), "vector-classes")
    asking = rows.where(queries)
    asked = base.stage(asking.select("vector").distinct().join(classes, "vector").select("id", "vector"), "query-classes")

    sizes = classes.groupBy(F.size("vector").alias("size")).count().collect()  # one row for each dimension in use
    families = {}
    for size, count in sizes:
        sample = classes.where(F.size("vector") == size).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()
        functions, width, probes = fit(np.array([r[0] for r in sample]), count, k, tables, target, seed)
        families[size] = HashFamily.draw(size, tables, functions, width, probes, seed)

    stored = base.stage(classes.select("id", "vector").mapInArrow(_hashed(families, 0), ENTRIES), "hash-tables")
    probed = asked.mapInArrow(_hashed(families, 1), ENTRIES)
    found = base.stage(_ranked(_in_blocks(stored, probed, block_rows), keep), "neighbour-classes")

    members = classes.select("id", F.size("ids").alias("members"))
    enough = found.join(members, "id").groupBy("query").agg(F.sum("members").alias("members")).where(F.col("members") >= keep)
    short = asked.join(enough.select(F.col("query").alias("id")), "id", "left_anti")
    everywhere = lambda df, kind: df.select(F.lit(-1).alias("tab"), F.size("vector").cast("long").alias("bucket"), F.lit(kind).alias("kind"), "id", "vector")
    whole = _ranked(_in_blocks(everywhere(classes, 0), everywhere(short, 1), block_rows), keep)
    found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(base.stage(whole, "searched-whole"))

    listed = found.join(classes.select("id", "ids"), "id").select("query", F.transform("ids", lambda i: F.struct(F.col("distance").alias("distance"), i.alias("id"))).alias("near"))
    listed = listed.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))
    listed = base.stage(asked.join(listed, asked["id"] == listed["query"]).select("vector", "near"), "neighbour-lists")
    each = asking.distinct().join(listed, "vector").select(F.col("id").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("place", "n")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.distance").alias("distance"))
