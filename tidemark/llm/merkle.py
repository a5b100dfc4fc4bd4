"""A Merkle manifest of a dataset: one hash tree per group of rows and one above the groups, with a proof for every row.

A row's leaf is the SHA-256 of its fields. Every three consecutive nodes of a level become one parent, the hash of their
lowercase hex texts; a last run may have one or two. A group's last node is its subroot, and the subroots, in the order
of the groups, are the leaves of one more tree whose last node is the root.

Method: concatenated-level strings. Positions come from one range-partitioned sort and a table of counts by (group, part);
no window orders a group. Aligned blocks of 3**``HEIGHT`` nodes each keep a level as one string of 64 hex digits per node.
Parents are hashes of fixed-width substrings of it, siblings the substrings that flank a node's own. The top nodes of the blocks are the
nodes of the next, 3**``HEIGHT`` times smaller table, and so on until every group has one. Paths come down the same way.
A block is an ordinary group of a bounded number of rows, so a group that holds a third of all rows is only more blocks.

Null fields hash as ``-``, others as byte count, ``:`` and value, so an empty text differs from a null one. Rows whose key is
null come first; rows with one key follow their leaf's order, so repeated rows stand side by side, each with its own proof.
Null is a group of its own, the first. Texts of any length are hashed whole where they are read and never moved. An empty table
gives no rows. Only the named columns are read, whatever else the input holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

FANOUT, HEIGHT, DIGITS = 3, 5, 64
BLOCK = FANOUT**HEIGHT
#: What identifies a document here, in the order in which it is hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Hash of a row's fields, each marked by its length."""
    texts = [c.cast("string") for c in fields]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The top node that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, run: hashed(run["left"], node, run["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, lowest level first, left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) and each one's ``position`` in its group by ``order``, and the group's ``total``."""
    by = ["grp", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = dealt.withColumns({"part": F.spark_partition_id(), "number": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    kept = base.stage(numbered, "merkle-rows")
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept.groupBy("grp", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    starts = base.stage(parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")), "merkle-starts")
    return kept.join(starts, ["grp", "part"]).withColumn("position", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def _parents(level: Column) -> Column:
    """The next level's string."""
    width = FANOUT * DIGITS
    starts = F.sequence(F.lit(0), ((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _levels(total: Column) -> Column:
    """How many levels of a block have more than one node in their group: all, or fewer in the group's only block."""
    return F.coalesce(*[F.when(total <= FANOUT**h, h) for h in range(HEIGHT)], F.lit(HEIGHT))


def _path(levels: Column, place: Column) -> Column:
    """Left and right siblings of a block's node at ``place``, level by level; ``levels`` ends with the top node."""

    def siblings(level: Column, height: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(FANOUT)), height)).cast("int")
        first = at - at % FANOUT
        left = F.substring(level, first * DIGITS + 1, (at - first) * DIGITS)
        right = F.substring(level, (at + 1) * DIGITS + 1, (first + FANOUT - 1 - at) * DIGITS)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), siblings)


def _tree(nodes: DataFrame) -> DataFrame:
    """(grp, carry, hash, path, top) for nodes (grp, position, total, hash, carry)."""
    block = F.floor(F.col("position") / BLOCK)
    grouped = nodes.groupBy("grp", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", "hash", "carry"))).alias("nodes"), F.max("total").alias("total")
    )
    lowest = F.array_join(F.transform("nodes", lambda x: x["hash"]), "")
    steps = F.when(_levels(F.col("total")) > 0, F.sequence(F.lit(1), _levels(F.col("total")))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(lowest), lambda seen, _: F.concat(seen, F.array(_parents(F.element_at(seen, -1)))))
    blocks = base.stage(grouped.withColumn("levels", levels), "merkle-blocks")
    top = F.element_at("levels", -1)
    none = F.array().cast("array<struct<left:string,right:string>>")
    if blocks.where(F.col("total") > BLOCK).isEmpty():
        blocks = blocks.withColumns({"above": none, "top": top})
    else:
        heads = blocks.select("grp", F.col("block").alias("position"), F.ceil(F.col("total") / BLOCK).alias("total"), top.alias("hash"), F.col("block").alias("carry"))
        above = _tree(heads).select("grp", F.col("carry").alias("block"), F.col("path").alias("above"), "top")
        blocks = blocks.join(above, ["grp", "block"])
    rows = blocks.select("grp", "levels", "above", "top", F.posexplode("nodes").alias("place", "node"))
    return rows.select("grp", "node.carry", "node.hash", F.concat(_path(F.col("levels"), F.col("place")), F.col("above")).alias("path"), "top")


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "source", key: str = "doc_id", revised: dict[str, Column] | None = None) -> DataFrame:
    """(``key``, leaf, subroot, root, path, revised_leaf) of every row; ``path`` holds the siblings up to the root.

    ``revised`` gives other values of some fields, as columns over ``fields``: their leaf is ``revised_leaf``, which a
    reader folds with ``path`` to test whether a row with those values belongs to the dataset. It is the leaf itself where nothing differs.
    """
    rows = base.pick(docs, *dict.fromkeys([*fields, group, key]))
    leaf = leaf_of([F.col(c) for c in fields])
    other = leaf_of([(revised or {}).get(c, F.col(c)) for c in fields])
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null is first
    leaves = rows.select(named.alias("grp"), F.col(key).alias("key"), leaf.alias("hash"), (other if revised else F.lit(None).cast("string")).alias("other"))
    placed = _placed(leaves.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other"))), ["key", "hash"])
    below = _tree(placed.select("grp", "position", "total", "hash", F.struct("key", "other").alias("carry")))
    below = base.stage(below.select("grp", "carry.*", "hash", "path", "top"), "merkle-leaves")

    tops = below.groupBy("grp").agg(F.first("top").alias("hash")).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "hash")
    above = _tree(_placed(tops, ["name"]).select("grp", "position", "total", "hash", F.col("name").alias("carry")))
    above = base.stage(above.select(F.col("carry").alias("grp"), F.col("path").alias("above"), F.col("top").alias("root")), "merkle-groups")
    joined = below.join(above, "grp")
    return joined.select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "above").alias("path"), F.coalesce("other", "hash").alias("revised_leaf"),
    )


def _sql(levels: int = 13, group_levels: int = 6) -> str:
    """The op13 query in DuckDB SQL, level by level; enough for 3**13 documents a source and 3**6 sources."""
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(text if c == "text" else c) for c in FIELDS) + "))"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    ctes = [
        f"leaves AS (SELECT doc_id, coalesce('+' || source, '') AS grp, {leaf('text')} AS leaf, CASE WHEN (xor({crc}, 4294967295)) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS tampered FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)",
        "d0 AS (SELECT grp, pos, leaf AS h FROM placed)",
        "p0 AS (SELECT *, pos AS idx, '' AS proof, tampered AS fold FROM placed)",
    ]

    def climb(nodes: str, paths: str, runs: str, count: int) -> None:
        for k in range(count):
            ctes.append(f"{runs}{k} AS (SELECT grp, pos // 3 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {nodes}{k}) GROUP BY ALL)")
            ctes.append(f"{nodes}{k + 1} AS (SELECT grp, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {runs}{k})")
            left, right = "array_to_string(r.hs[1:(p.idx % 3)::BIGINT], '')", "array_to_string(r.hs[(p.idx % 3 + 2)::BIGINT:], '')"
            ctes.append(
                f"{paths}{k + 1} AS (SELECT p.* EXCLUDE (idx, proof, fold), p.idx // 3 AS idx, p.proof || {left} || {right} AS proof, "
                f"CASE WHEN r.n > 1 THEN sha256({left} || p.fold || {right}) ELSE p.fold END AS fold FROM {paths}{k} p JOIN {runs}{k} r ON p.grp = r.grp AND p.idx // 3 = r.run)"
            )

    climb("d", "p", "r", levels)
    ctes.append(f"tops AS (SELECT grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos FROM d{levels})")
    ctes.append("e0 AS (SELECT 0 AS grp, pos, h FROM tops)")
    ctes.append(f"q0 AS (SELECT 0 AS grp, p.doc_id, p.leaf, t.h AS subroot, t.pos AS idx, p.proof, p.fold FROM p{levels} p JOIN tops t ON p.grp = t.name)")
    climb("e", "q", "s", group_levels)
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT q.doc_id, q.leaf, q.subroot, e.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = e.h AS verified FROM q{group_levels} q, e{group_levels} e"
    )


SQL = _sql()
