"""Connected components: of graphs (edge tables) and of raster masks (cell tables)."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridfold.session import cut, dealt

TILE = 128


FIT = 1_000_000  # edges that one task finishes


def _finish(graph: DataFrame, keys: list[str]) -> DataFrame:
    """Components of at most FIT edges in one task: smallest labels are hooked and pointers flattened in arrays."""
    schema = "".join(f"{k} {graph.schema[k].dataType.simpleString()}, " for k in keys) + "node long, root long"

    def label(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
        ends = pd.DataFrame({"g": np.tile(group, 2), "node": np.concatenate([pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)])})
        nodes = ends.drop_duplicates().sort_values(["g", "node"], ignore_index=True)
        place = ends.merge(nodes.assign(i=np.arange(len(nodes))), on=["g", "node"], how="left")["i"].to_numpy()
        lab = flatten(np.arange(len(nodes)), place[:len(pdf)], place[len(pdf):])
        first = pdf[keys].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True)
        yield first.iloc[nodes["g"]].reset_index(drop=True).assign(node=nodes["node"].to_numpy(), root=nodes["node"].to_numpy()[lab])

    return cut(graph.coalesce(1).mapInPandas(label, schema))


def flatten(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of each connected set of indices linked by (u, v)."""
    while True:
        low = np.minimum(lab[u], lab[v])
        old = lab.copy()
        np.minimum.at(lab, lab[u], low)
        np.minimum.at(lab, lab[v], low)
        while True:
            flat = lab[lab]
            if np.array_equal(flat, lab):
                break
            lab = flat
        if np.array_equal(lab, old):
            return lab


def graph_components(edges: DataFrame, keys: list[str], fit: int = FIT) -> DataFrame:
    """Components of an undirected edge table ``keys, u, v`` (long ids): ``keys, node, root``.

    Every node hooks to its smallest neighbour, pointers are doubled until flat, and the graph
    is contracted to its roots; parallel edges collapse, so the edge table shrinks every round
    and a node with a third of all edges is one row after the first.  What is left is finished in
    one task as soon as it has ``fit`` edges or fewer.
    """
    keys_n = [*keys, "node"]
    graph = cut(edges.select(*keys, F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).distinct())
    total = None
    while graph.count() > fit:
        both = graph.select(*keys, F.col("u").alias("node"), "v").unionByName(graph.select(*keys, F.col("v").alias("node"), F.col("u").alias("v")))
        hook = cut(both.groupBy(*keys_n).agg(F.min("v").alias("m")).withColumn("root", F.least("m", "node")).drop("m"))
        while True:  # two pointer doublings per materialised step
            for _ in range(2):
                up = hook.select(*keys, F.col("node").alias("root"), F.col("root").alias("top"))
                hook = hook.join(up, [*keys, "root"], "left").select(*keys_n, F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
            hook = cut(hook)
            if hook.where("moved").isEmpty():
                hook = hook.drop("moved")
                break
            hook = hook.drop("moved")
        total = hook if total is None else _onward(total, hook, keys)
        a = hook.select(*keys, F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hook.select(*keys, F.col("node").alias("v"), F.col("root").alias("rv"))
        graph = cut(graph.join(a, [*keys, "u"]).join(b, [*keys, "v"]).where("ru <> rv")
                    .select(*keys, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    last = _finish(graph, keys)
    return last if total is None else _onward(total, last, keys)


def _onward(total: DataFrame, hook: DataFrame, keys: list[str]) -> DataFrame:
    step = hook.select(*keys, F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(total.join(step, [*keys, "root"], "left").select(*keys, "node", F.coalesce("top", "root").alias("root")))


def label_block(rows: np.ndarray, cols: np.ndarray, code: np.ndarray, eight: bool = False, walls=None) -> np.ndarray:
    """Smallest ``code`` of each connected set of cells inside one block (vectorised).
    ``walls``: per cell (closed to the next column, closed to the next row)."""
    r0, c0 = rows.min(), cols.min()
    h, w = rows.max() - r0 + 1, cols.max() - c0 + 1
    index = np.full((h + 2, w + 2), -1, np.int64)
    index[rows - r0 + 1, cols - c0 + 1] = np.arange(len(rows))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    us, vs = [], []
    here = index[1:-1, 1:-1]
    for dr, dc in steps:
        there = index[1 + dr:h + 1 + dr, 1 + dc:w + 1 + dc]
        ok = (here >= 0) & (there >= 0)
        if walls is not None:
            ok &= ~walls[0 if dc else 1][np.maximum(here, 0)]
        us.append(here[ok])
        vs.append(there[ok])
    u, v = np.concatenate(us), np.concatenate(vs)
    order = np.argsort(code, kind="stable")
    rank = np.empty(len(code), np.int64)
    rank[order] = np.arange(len(code))
    u, v = rank[u], rank[v]
    return code[order][flatten(np.arange(len(code)), u, v)[rank]]


def cell_components(cells: DataFrame, keys: list[str], tile: int = TILE, eight: bool = False,
                    width: int = 1 << 31, walls: bool = False) -> DataFrame:
    """4- (or 8-) connected components of a mask: input columns plus ``component``.

    ``component`` is the smallest ``row * width + col`` of the component.  Tiles are labelled
    independently (bounded groups); only the labels on both sides of a tile seam enter the
    graph step.  ``keys`` may include a class, so that equal classes connect.  With ``walls``
    the boolean columns ``wall_c, wall_r`` close a cell to the next column / row.
    """
    extra = ["wall_c", "wall_r"] if walls else []
    base = cells.select(*keys, "row", "col", *extra).withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    schema = ", ".join([f"{k} {base.schema[k].dataType.simpleString()}" for k in keys]
                       + ["row int", "col int"] + [f"{w} boolean" for w in extra] + ["_tr long", "_tc long", "local long"])
    names = [*keys, "row", "col", *extra, "_tr", "_tc", "local"]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        shut = [pdf[w].to_numpy(bool) for w in extra] or None
        return pdf.assign(local=label_block(r, c, r * width + c, eight, shut))[names]

    local = cut(base.groupBy(*keys, "_tr", "_tc").applyInPandas(label, schema))
    seam = local.where(f"pmod(row, {tile}) in (0, {tile - 1}) or pmod(col, {tile}) in (0, {tile - 1})")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in steps])
    there = (seam.select(*keys, "_tr", "_tc", F.col("local").alias("u"), "row", "col", *extra, F.explode(moves).alias("m"))
             .where(F.when(F.col("m.dc") == 1, ~F.col("wall_c")).otherwise(~F.col("wall_r")) if walls else F.lit(True))
             .select(*keys, "_tr", "_tc", "u", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"))
             .where(f"_tr <> floor(row / {tile}) or _tc <> floor(col / {tile})").drop("_tr", "_tc"))
    edges = cut(there.join(dealt(seam.select(*keys, "row", "col", F.col("local").alias("v"))), [*keys, "row", "col"])
                .select(*keys, "u", "v").distinct())
    if edges.isEmpty():
        return local.withColumnRenamed("local", "component").drop("_tr", "_tc", *extra)
    roots = graph_components(edges, keys).withColumnRenamed("node", "local")
    return (local.join(dealt(roots), [*keys, "local"], "left")
            .withColumn("component", F.coalesce("root", "local")).drop("root", "local", "_tr", "_tc", *extra))


def span_parts(pieces: DataFrame, ids: list[str]) -> DataFrame:
    """Split span arrays (disjoint spans) into 4-connected parts: the columns of ``pieces``, ``part`` (place of
    the part's first span), ``cells``.

    A piece is a row, so its touching spans are linked where the row is: all pieces of a batch at
    once, without a shuffle.  Pieces without spans go.
    """
    from gridfold.operators import spans as S
    names = pieces.columns
    at = names.index("spans")

    def split(batches):
        for batch in batches:
            spans = batch.column(at)
            sizes = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            part = _touching(owner, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "c0", "c1")))
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows, root = owner[order[first]], part[order[first]]
            ends = np.append(first, len(order)).astype(np.int32)
            columns = list(batch.take(pa.array(rows)).columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(order)))
            start = (np.cumsum(sizes) - sizes)[rows]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(root - start, pa.int64())], [*names, "part"])

    schema = StructType([*pieces.schema.fields, StructField("part", LongType())])
    parts = pieces.where(F.size("spans") > 0).mapInArrow(split, schema)
    return parts.withColumn("cells", S.cell_count(F.col("spans")))


def _touching(owner: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Smallest index of the spans that hang together, for the spans of many owners."""
    n = len(row)
    order = np.lexsort((c0, row, owner))
    owner, row, left = owner[order], row[order], c0[order]
    right = c1[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    line = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    below = np.append((owner[heads[1:]] == owner[heads[:-1]]) & (row[heads[1:]] == row[heads[:-1]] + 1), False)
    low = left.min() if n else 0
    place = lambda k, c: (k << 32) + (c - low)
    here = np.flatnonzero(below[line])
    lo = np.searchsorted(place(line, right), place(line[here] + 1, left[here]), "right")
    hi = np.searchsorted(place(line, left), place(line[here] + 1, right[here]), "left")
    many = np.maximum(hi - lo, 0)
    beside = np.flatnonzero(~fresh[1:] & (right[:-1] >= left[1:]))
    u = np.concatenate([np.repeat(here, many), beside])
    v = np.concatenate([np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum()), beside + 1])
    return flatten(np.arange(n), order[u], order[v])
