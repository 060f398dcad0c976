"""Merkle manifest of a table: a distributed tree of bounded fan-out and its tampered versions.

Leaves are numbered per key by a range sort.  A task builds the tree over one aligned block of
``fan ** depth`` nodes; block roots are the nodes of the next step, so a few steps reach one root per
key, and the roots of all keys form one more tree.  Going back down, each block learns its way up:
what stands left and right of it on every level.  A changed leaf makes a version of the tree
that copies the nodes on its own way up and shares all others: first those inside its block,
then, along the block's way, those of the upper blocks.
"""
from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import numbered
from gridfold.session import cut

FAN, DEPTH = 8, 4          # children of a node, levels a block holds
ROWS_OUT = 2048            # rows of a batch that goes back to Spark
WAY = "array<struct<left:string,right:string>>"
NODE = "key string, idx long, n long, digest string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(n: int, fan: int = FAN) -> int:
    """Levels between ``n`` nodes and their root."""
    up = 0
    while n > 1:
        n, up = -(-n // fan), up + 1
    return up


class Tree:
    """An immutable tree over a block's digests; versions share all nodes but their own copies."""

    def __init__(self, digests: list[str], depth: int, fan: int = FAN):
        self.fan, self.levels = fan, [digests]
        for _ in range(depth):
            last = self.levels[-1]
            self.levels.append([digest_of(*last[i:i + fan]) for i in range(0, len(last), fan)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def way(self, leaf: int) -> list[tuple[str, str]]:
        """Level by level, the digests left and right of the leaf's ancestor in its run."""
        out, at = [], leaf
        for level in self.levels[:-1]:
            start = at - at % self.fan
            out.append(("".join(level[start:at]), "".join(level[at + 1:start + self.fan])))
            at //= self.fan
        return out

    def version(self, leaf: int, digest: str, onward=()) -> "Version":
        return Version(self, leaf, digest, onward)


class Version:
    """The tree with one leaf replaced: copies of its ancestors, also along ``onward`` (the way of the
    block's root through upper blocks), and the nodes of the base tree for all the rest."""

    def __init__(self, base: Tree, leaf: int, digest: str, onward=()):
        self.base, self.leaf, self.copies = base, leaf, [digest]
        for left, right in [*base.way(leaf), *onward]:
            self.copies.append(digest_of(left, self.copies[-1], right))

    def node(self, level: int, at: int) -> str:
        return self.copies[level] if at == self.leaf // self.base.fan ** level else self.base.levels[level][at]

    @property
    def root(self) -> str:
        return self.copies[-1]


def _blocks(batches, fan: int, depth: int):
    """Consecutive rows of one (key, block) as tuples; batches may cut a block anywhere."""
    size = fan ** depth
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, key=lambda r: (r[0], r[1] // size))


def _chunks(rows, schema: pa.Schema):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _dealt(nodes: DataFrame, size: int, *order: str) -> DataFrame:
    """Whole blocks to one task each, in order: the hot key is spread over its blocks."""
    block = F.floor(F.col("idx") / size)
    return nodes.repartition(F.col("key"), block).sortWithinPartitions("key", block, *order)


def block_roots(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Nodes (key, idx, n, digest) of one step -> those of the next, one per block.  A key with one
    node keeps it."""
    schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def work(batches):
        def roots():
            for (key, block), rows in _blocks(batches, fan, depth):
                rows = list(rows)
                n = rows[0][2]
                yield key, block, -(-n // fan ** depth), Tree([r[3] for r in rows], min(depth, levels_above(n, fan)), fan).root
        return _chunks(roots(), schema)

    slim = nodes.select("key", F.col("idx").cast("long"), F.col("n").cast("long"), "digest")
    return _dealt(slim, fan ** depth, "idx").mapInArrow(work, NODE)


def _with_ways(nodes: DataFrame, above: DataFrame, fan: int, depth: int) -> DataFrame:
    """Nodes of a step, and in front of each block the way of its root (from ``above``: key, idx, way)."""
    size = fan ** depth
    ways = above.select("key", (F.col("idx") * size).alias("idx"), "way", F.lit(0).alias("_turn"))
    return _dealt(nodes.withColumn("_turn", F.lit(1)).unionByName(ways, allowMissingColumns=True), size, "_turn", "idx")


def ways_down(nodes: DataFrame, above: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """key, idx, way of every node of a step, from the ways of the next step's nodes."""
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("way", pa.list_(pair))])

    def work(batches):
        def out():
            for (key, _), rows in _blocks(batches, fan, depth):
                up = next(rows)[4]
                rows = list(rows)
                tree = Tree([r[3] for r in rows], min(depth, levels_above(rows[0][2], fan)), fan)
                for i, r in enumerate(rows):
                    yield key, r[1], [{"left": a, "right": b} for a, b in tree.way(i)] + up
        return _chunks(out(), schema)

    return _with_ways(nodes.select("key", "idx", "n", "digest"), above, fan, depth).select("key", "idx", "n", "digest", "way").mapInArrow(work, f"key string, idx long, way {WAY}")


def _climb(nodes: DataFrame, most: int, fan: int, depth: int) -> list[DataFrame]:
    """All steps from ``nodes`` to one node per key; ``most`` is the largest key's number of nodes."""
    steps = [nodes]
    while most > 1:
        steps.append(cut(block_roots(steps[-1], fan, depth)))
        most = -(-most // fan ** depth)
    return steps


def numbered_in_key(df: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` (from 0 in ``order``) and ``n`` (rows) inside each key, keys null first.

    One range sort over (key, order); places are counted inside (range, key) and the sizes of
    these pieces, as many as ranges and keys together, are added up.  No key is one task.
    """
    at = numbered(df, ["key", *order], "_row")
    split = at.withColumn("_piece", F.floor(F.col("_row") / 65536))
    pieces = split.groupBy("key", "_piece").agg(F.count("*").alias("_n"), F.min("_row").alias("_from"))
    whole = Window.partitionBy("key")
    before = F.sum("_n").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    pieces = pieces.select(F.col("key").alias("_key"), F.col("_piece").alias("_p"), (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return (split.join(pieces, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_p")))
            .withColumn("idx", F.col("_row") + F.col("_shift")).drop("_key", "_piece", "_p", "_row", "_shift"))


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 over the values, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def manifest(rows: DataFrame, key: str, order: str, leaf: Column, changed: Column, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``rows``: order column, key, idx, leaf, way, subroot, root, copies.

    Leaves ascend by ``order`` (a long; null first; equal ones by digest) inside each key, and keys
    ascend bytewise, null first.  ``way`` lists what stands left and right of the leaf's ancestors up to the root
    (its proof); ``copies`` are the digests on the way of the version in which ``changed`` (null: the leaf
    itself) replaces the leaf: the last one is that version's root.  Repeated rows are leaves of
    their own.  An empty table has no rows.
    """
    slim = cut(rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("item"), leaf.alias("digest"), changed.alias("changed")))
    leaves = cut(numbered_in_key(slim, ["item", "digest"]))
    most = leaves.agg(F.max("n")).first()[0] or 0
    steps = _climb(leaves, most, fan, depth)
    # one node per key is left: these are the leaves of the upper tree
    tops = cut(steps[-1].select("key", "digest"))
    upper = cut(numbered(tops, ["key"], "idx").crossJoin(F.broadcast(tops.agg(F.count("*").alias("n"))))  # one row
                .select(F.lit("").alias("key"), "idx", "n", "digest", F.col("key").alias("name")))
    upper_steps = _climb(upper, upper.count(), fan, depth)
    way = upper_steps[-1].select("key", F.lit(0).cast("long").alias("idx"), F.expr(f"cast(array() as {WAY})").alias("way"))
    for step in reversed(upper_steps[:-1]):
        way = cut(ways_down(step, way, fan, depth))
    named = way.select("idx", "way").join(upper.select("idx", F.col("name"), "digest"), "idx")
    above = cut(named.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("idx"), "way"))
    for step in reversed(steps[1:-1]):
        above = cut(ways_down(step, above, fan, depth))
    return _leaf_versions(leaves, above, fan, depth)


def _leaf_versions(leaves: DataFrame, above: DataFrame, fan: int, depth: int) -> DataFrame:
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("item", pa.int64()), ("key", pa.string()), ("idx", pa.int64()), ("leaf", pa.string()), ("way", pa.list_(pair)),
                        ("subroot", pa.string()), ("root", pa.string()), ("copies", pa.list_(pa.string()))])

    def work(batches):
        def out():
            for (key, _), rows in _blocks(batches, fan, depth):
                up = next(rows)[4]
                rows = list(rows)
                levels = levels_above(rows[0][2], fan)
                tree = Tree([r[3] for r in rows], min(depth, levels), fan)
                onward = [(w["left"], w["right"]) for w in up]
                roots = [tree.root]  # of the block, and on its way up
                for left, right in onward:
                    roots.append(digest_of(left, roots[-1], right))
                subroot = roots[levels - min(depth, levels)]
                for i, r in enumerate(rows):
                    way = [{"left": a, "right": b} for a, b in tree.way(i)] + up
                    yield r[5], key, r[1], r[3], way, subroot, roots[-1], tree.version(i, r[3] if r[6] is None else r[6], onward).copies
        return _chunks(out(), schema)

    flat = _with_ways(leaves.select("key", "idx", "n", "digest", "item", "changed"), above, fan, depth).select("key", "idx", "n", "digest", "way", "item", "changed")
    return flat.mapInArrow(work, f"item long, key string, idx long, leaf string, way {WAY}, subroot string, root string, copies array<string>")


def document_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of a documents table by lang and doc_id; texts of the documents whose id has a CRC-32 that 3 divides
    are tampered with: their A-Z become a-z.  A null id is never tampered with."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest([*columns[:4], lowered]))
    return manifest(docs, "lang", "doc_id", leaf_digest(columns), tampered)


def proof_digest(way: Column) -> Column:
    """sha256 over all siblings of a way, from the leaf's level up."""
    return F.sha2(F.array_join(F.transform(way, lambda w: F.concat(w["left"], w["right"])), ""), 256)
