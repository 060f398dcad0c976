"""Ordered lines from edge tables: list ranking by pointer doubling over half-edges.

Every undirected edge is two half-edges; behind a node of degree 2 a half-edge has exactly one
successor.  Pointers that look 1, 2, 4 ... half-edges ahead are all different, so no join of a
round has a hot key however long one line is, and log2(longest line) rounds order all lines.
What lies in front of a half-edge is what lies behind its twin in the mirrored line, so places
from the start need no further pass and no group per line.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.session import cut


def half_edges(edges: DataFrame, keys: list[str], length: str | None = None) -> DataFrame:
    """Both directions of ``keys, u, v`` (distinct, u <> v), with ``ahead``: the node behind ``v`` where
    exactly two edges meet in ``v`` (null elsewhere), and ``length`` (1 if none is named)."""
    size = F.col(length).cast("double") if length else F.lit(1.0)
    flat = edges.select(*keys, "u", "v", size.alias("length"))
    both = cut(flat.unionByName(flat.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), "length")))
    # degree, smallest and largest neighbour say all about a node of degree 2
    node = both.groupBy(*keys, F.col("u").alias("v")).agg(F.count("*").alias("_d"), F.min("v").alias("_a"), F.max("v").alias("_b"))
    other = F.when(F.col("_d") == 2, F.when(F.col("_a") == F.col("u"), F.col("_b")).otherwise(F.col("_a")))
    return both.join(node, [*keys, "v"]).select(*keys, "u", "v", "length", other.alias("ahead"))


def _rank(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Half-edges of lines with an end: ``last_u, last_v, hops, rest`` (edges and length from here to the
    end); and the half-edges of cycles with ``low``, the smallest node of the cycle."""
    state = rows.select(*keys, "u", "v", "length", "ahead", F.when(F.col("ahead").isNotNull(), F.col("v")).alias("nu"), F.col("ahead").alias("nv"),
                        F.when(F.col("ahead").isNull(), F.col("u")).alias("last_u"), F.when(F.col("ahead").isNull(), F.col("v")).alias("last_v"),
                        F.lit(1).cast("long").alias("hops"), F.col("length").alias("rest"), F.col("u").alias("low"))
    state = cut(state)
    own = [*keys, "u", "v", "length", "ahead"]
    while True:
        there = state.select(*keys, F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("_nu"), F.col("nv").alias("_nv"), F.col("last_u").alias("_lu"),
                             F.col("last_v").alias("_lv"), F.col("hops").alias("_hops"), F.col("rest").alias("_rest"), F.col("low").alias("_low"))
        moved = state.where("nv is not null").join(there, [*keys, "nu", "nv"]).select(
            *own, F.col("_nu").alias("nu"), F.col("_nv").alias("nv"), F.col("_lu").alias("last_u"), F.col("_lv").alias("last_v"), (F.col("hops") + F.col("_hops")).alias("hops"),
            (F.col("rest") + F.col("_rest")).alias("rest"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_sank"))
        state = cut(state.where("nv is null").withColumn("_sank", F.lit(None).cast("boolean")).unionByName(moved))
        seen = state.where("_sank is not null").agg(F.count_if(F.col("nv").isNull()).alias("ended"), F.count_if(F.col("_sank")).alias("sank")).first()
        state = state.drop("_sank")
        if not seen["ended"] and not seen["sank"]:  # a line with an end ends somewhere every round, a cycle sinks until its smallest node is known
            break
    return state.where("nv is null").drop("nu", "nv", "low"), state.where("nv is not null").select(*own, "low")


def ordered_lines(edges: DataFrame, keys: list[str], length: str | None = None) -> DataFrame:
    """Edges of ``keys, u, v`` (long node ids) along lines between nodes of degree other than 2, and along
    cycles cut at their smallest node: ``keys, first, second, pos, u, v, ahead, edges, length, before, total``.

    ``first, second`` are the first two nodes of a line and name it; of its two directions the one
    with the smaller (first, second) is given.  ``pos`` counts edges from 0, ``before`` is the length in front of
    the edge, ``edges`` and ``total`` belong to the whole line, ``ahead`` is the next node (null at the end).
    Repeated edges and loops must be gone; an empty table has no lines.
    """
    halves = half_edges(edges, keys, length)
    open_, cycles = _rank(halves, keys)
    if not cycles.isEmpty():
        closed = cycles.withColumn("ahead", F.when(F.col("v") != F.col("low"), F.col("ahead"))).drop("low")
        open_ = open_.unionByName(_rank(closed, keys)[0])
    open_ = cut(open_)
    twin = open_.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), F.col("last_v").alias("first"), F.col("last_u").alias("second"),
                        (F.col("hops") - 1).alias("pos"), (F.col("rest") - F.col("length")).alias("before"))
    both = open_.join(twin, [*keys, "u", "v"]).where("first < last_v or first = last_v and second <= last_u")
    return both.select(*keys, "first", "second", "pos", "u", "v", "ahead", (F.col("pos") + F.col("hops")).alias("edges"), "length", "before", (F.col("before") + F.col("rest")).alias("total"))


def line_vertices(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices of ``ordered_lines`` in order: ``keys, first, second, pos, node, along, ahead, behind`` (nodes next
    and before on the line, null at its ends; the start of a cycle is also its end)."""
    end = F.struct((F.col("pos") + 1).alias("pos"), F.col("v").alias("node"), (F.col("before") + F.col("length")).alias("along"), F.col("ahead").alias("ahead"), F.col("u").alias("behind"))
    start = F.struct(F.col("pos").alias("pos"), F.col("u").alias("node"), F.col("before").alias("along"), F.col("v").alias("ahead"), F.lit(None).cast("long").alias("behind"))
    return lines.select(*keys, "first", "second", F.inline(F.when(F.col("pos") == 0, F.array(start, end)).otherwise(F.array(end))))
