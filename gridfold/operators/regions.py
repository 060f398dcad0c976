"""Regions on raster tables: cores, growth, adjacency, merging, separation, outlines.

Cells are rows ``keys, row, col, ...``.  Work that needs neighbourhoods runs per tile with a
halo of copied border cells, so a group is bounded by the tile size; region graphs (one row
per region or per touching pair) are what the merge rules see, never cells.
"""
from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.operators.chains import line_vertices, ordered_lines
from gridfold.operators.components import cell_components, graph_components
from gridfold.operators.merging import MOST, merged_colours, merged_constrictions
from gridfold.session import cut, dealt

TILE = 128


def with_halo(cells: DataFrame, tile: int, reach: int) -> DataFrame:
    """Copies of each cell for every tile within ``reach``: adds ``_tr, _tc, _own``."""
    def tiles(c):
        return F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    out = cells.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))
    return out.withColumn("_own", (F.col("_tr") == F.floor(F.col("row") / tile)) & (F.col("_tc") == F.floor(F.col("col") / tile)))


def _schema(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def cores(cells: DataFrame, keys: list[str], reach: int, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """Cells of a component farther than ``reach`` cells from any in-frame cell outside it
    (exact integer squared distances; the frame itself is no edge).  Needs ``component``."""
    src = with_halo(cells.select(*keys, "row", "col", "component"), tile, reach)
    disc = [(dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if dr * dr + dc * dc <= reach * reach]

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - 2 * reach, int(pdf["_tc"].iloc[0]) * tile - 2 * reach
        n = tile + 4 * reach
        rr, cc = np.arange(n) + r0, np.arange(n) + c0
        grid = np.zeros((n, n), np.int64)
        grid[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pd.factorize(pdf["component"])[0] + 1
        outside = ((rr < 0) | (rr >= rows))[:, None] | ((cc < 0) | (cc >= cols))[None, :]
        keep = grid > 0
        for dr, dc in disc:
            there = np.roll(grid, (-dr, -dc), (0, 1))
            off = np.roll(outside, (-dr, -dc), (0, 1))
            keep &= (there == grid) | off
        ok = keep[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] & pdf["_own"].to_numpy()
        return pdf.loc[ok, [*keys, "row", "col", "component"]]

    return src.groupBy(*keys, "_tr", "_tc").applyInPandas(inner, _schema(cells, [*keys, "row", "col", "component"]))


_STEP, _LEVEL, _NEVER = 1 << 22, 1 << 50, np.iinfo(np.int64).max


def settle_tile(code: np.ndarray, level: np.ndarray, fixed: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Fixpoint of arrival codes (level, step, label rank) inside one padded tile."""
    own = (level.astype(np.int64) + 1) * _LEVEL + _STEP
    while True:
        best = np.full(code.shape, _NEVER)
        for shift, axis in ((1, 0), (-1, 0), (1, 1), (-1, 1)):
            near = np.roll(code, shift, axis)
            seen = near != _NEVER
            came = np.where(level + 1 > near // _LEVEL, own + near % _STEP, near + _STEP)
            best = np.where(seen, np.minimum(best, came), best)
        new = np.where(fixed, code, np.where(region, best, _NEVER))
        if np.array_equal(new, code):
            return code
        code = new


def grow(cells: DataFrame, keys: list[str], tile: int = TILE, steps: int | None = None) -> DataFrame:
    """Grow labelled seeds over a region, one 4-step at a time: ``keys, row, col, label``.

    Input: ``row, col, seed`` (NULL where unlabelled) and ``level``: cells of a level open only
    once growth through the lower levels has stopped (0 everywhere = plain geodesic growth).
    A cell reached by several labels in the same step takes the larger one.  With ``steps`` a level's
    growth ends after so many; without, it goes on to the end.

    The result of every cell is the smallest (level, step, -label) over its neighbours.  Tiles
    settle many steps at once; border values are exchanged until none changes, so the number of
    rounds is the number of tiles on the longest path, not its length in cells.
    """
    names = [*keys, "row", "col", "seed", "level", "lv", "st", "label"]
    state = cells.select(*keys, "row", "col", F.col("seed").cast("long").alias("seed"), F.col("level").cast("int").alias("level"))
    state = state.withColumn("lv", F.when(F.col("seed").isNotNull(), F.lit(-1))).withColumn("st", F.when(F.col("seed").isNotNull(), F.lit(0).cast("long")))
    state = cut(state.withColumn("label", F.col("seed")))
    schema = _schema(state, names) + ", changed boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - 2, int(pdf["_tc"].iloc[0]) * tile - 2
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        own, seeded = pdf["_own"].to_numpy(), pdf["seed"].notna().to_numpy()
        known = pdf["label"].notna().to_numpy()
        marks = np.sort(pdf["label"].dropna().astype(np.int64).unique())[::-1]
        place = {int(v): i for i, v in enumerate(marks)}
        code = np.full((tile + 4, tile + 4), _NEVER)
        level, fixed, region = np.zeros(code.shape, np.int64), np.ones(code.shape, bool), np.zeros(code.shape, bool)
        level[r, c] = pdf["level"].to_numpy()
        fixed[r, c] = seeded | ~own
        region[r, c] = own
        use = known & (seeded | ~own)
        code[r[use], c[use]] = ((pdf["lv"].to_numpy()[use].astype(np.int64) + 1) * _LEVEL + pdf["st"].to_numpy()[use].astype(np.int64) * _STEP
                                + np.array([place[int(v)] for v in pdf["label"].to_numpy()[use]], np.int64))
        got = settle_tile(code, level, fixed, region)[r, c]
        done = got != _NEVER
        safe = np.where(done, got, 0)
        out = pdf[[*keys, "row", "col", "seed", "level"]].copy()
        out["lv"] = pd.array(np.where(done, safe // _LEVEL - 1, 0), dtype="Int32")
        out["st"] = pd.array(safe % _LEVEL // _STEP, dtype="Int64")
        out["label"] = pd.array(marks[safe % _STEP] if len(marks) else np.zeros(len(out), np.int64), dtype="Int64")
        out.loc[~done, ["lv", "st", "label"]] = pd.NA
        old = [pdf[x].fillna(-9).to_numpy() for x in ("lv", "st", "label")]
        new = [out[x].fillna(-9).to_numpy() for x in ("lv", "st", "label")]
        out["changed"] = (old[0] != new[0]) | (old[1] != new[1]) | (old[2] != new[2])
        return out[own]

    active = None
    while True:
        src = with_halo(state, tile, 1)
        if active is not None:
            idle = state.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile)).join(
                active, [*keys, "_tr", "_tc"], "left_anti").select(*names, F.lit(False).alias("changed"))
            src = src.join(active, [*keys, "_tr", "_tc"], "left_semi")
        out = src.groupBy(*keys, "_tr", "_tc").applyInPandas(settle, schema)
        out = cut(out if active is None else out.unionByName(idle))
        state = out.drop("changed")
        moved = with_halo(out.where("changed"), tile, 1).where("not _own")
        active = cut(moved.select(*keys, "_tr", "_tc").distinct())
        if active.isEmpty():
            late = F.lit(False) if steps is None else F.col("st") > steps
            return state.select(*keys, "row", "col", F.when(~late, F.col("label")).alias("label"))


def adjacency(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Shared 4-neighbour edges per label pair: ``keys, a, b, edges, across`` (horizontal ones)."""
    here = labels.select(*keys, "row", "col", F.col(label).alias("p"))
    moves = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    there = here.select(*keys, F.col("p").alias("q"), "row", "col", F.explode(moves).alias("m")).select(
        *keys, "q", (F.col("row") - F.col("m.dr")).alias("row"), (F.col("col") - F.col("m.dc")).alias("col"), F.col("m.dc").alias("across"))
    return (here.join(there, [*keys, "row", "col"]).where("p <> q")
            .groupBy(*keys, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .agg(F.count("*").alias("edges"), F.sum("across").cast("long").alias("across")))


def separate_instances(mask: DataFrame, keys: list[str], px: float, rows: int, cols: int, radius: float = 1.2,
                       min_part: float = 10.0, neck: float = 0.5, tile: int = TILE) -> DataFrame:
    """Components -> cores -> growth -> constriction merge-back: ``keys, row, col, instance``.
    Covers exactly the mask.  Components with at most one core stay whole."""
    comp = cut(cell_components(mask, keys, tile))
    reach = int(radius / px + 1e-6)
    core = cell_components(cores(comp, keys, reach, rows, cols, tile), [*keys], tile).withColumnRenamed("component", "core")
    core = cut(core)
    where = core.join(comp, [*keys, "row", "col"])
    many = cut(where.groupBy(*keys, "component").agg(F.count_distinct("core").alias("n")).where("n > 1").select(*keys, "component"))
    whole = comp.join(many, [*keys, "component"], "left_anti").select(*keys, "row", "col", F.col("component").alias("instance"))
    if many.isEmpty():
        return whole
    todo = comp.join(many, [*keys, "component"], "left_semi").join(core.withColumnRenamed("core", "seed"), [*keys, "row", "col"], "left")
    grown = cut(grow(todo.withColumn("level", F.lit(0)), keys, tile).join(comp, [*keys, "row", "col"]))
    return whole.unionByName(merged_regions(grown, keys, px, min_part, neck).select(*keys, "row", "col", F.col("label").alias("instance")))


def merged_regions(labels: DataFrame, keys: list[str], px: float, min_part: float, neck: float, most: int = MOST) -> DataFrame:
    """Apply the constriction rule to the region graph of each component and relabel its cells."""
    ids = [*keys, "component"]
    nodes = labels.groupBy(*ids, "label").agg(F.count("*").alias("cells"))
    pairs = adjacency(labels, keys).join(nodes.select(*ids, F.col("label").alias("a")), [*keys, "a"])
    moved = merged_constrictions(nodes, pairs, ids, px, min_part, neck, most)
    return labels.join(moved, [*ids, "label"], "left").select(*keys, "row", "col", "component", F.coalesce("final", "label").alias("label"))


def region_graph(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Region adjacency: nodes ``label, cells, sum_r, sum_g, outer, perimeter`` and pairs ``a, b,
    edges, strong`` from ``row, col, label, component, cr, cg, strong`` (strong: boolean)."""
    side = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    here = cells.select(*keys, "component", "label", "strong", "row", "col", F.explode(side).alias("m")).select(
        *keys, "component", "label", "strong", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"))
    other = cells.select(*keys, "row", "col", F.col("label").alias("o"), F.col("strong").alias("os"))
    rim = cut(here.join(other, [*keys, "row", "col"], "left").where("o is null or o <> label")
              .groupBy(*keys, "component", "label", "o").agg(F.count("*").alias("edges"), F.sum((F.col("strong") | F.coalesce("os", F.lit(False))).cast("long")).alias("strong")))
    perimeter = rim.groupBy(*keys, "label").agg(F.sum("edges").alias("perimeter"), F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("edges"))), F.lit(0).cast("long")).alias("outer"))
    nodes = cells.groupBy(*keys, "component", "label").agg(F.count("*").alias("cells"), F.sum("cr").alias("sum_r"), F.sum("cg").alias("sum_g")).join(perimeter, [*keys, "label"], "left")
    nodes = nodes.na.fill(0, ["perimeter", "outer"])
    pairs = rim.where("o > label").select(*keys, "component", F.col("label").alias("a"), F.col("o").alias("b"), "edges", "strong")
    return nodes, pairs


def guided_separation(cells: DataFrame, keys: list[str], px: float, **rules) -> tuple[DataFrame, DataFrame]:
    """Colour-guided merging of flooded regions (``row, col, component, label, cr, cg, strong``):
    relabelled cells (``candidate, instance``) and cut rows."""
    ids = [*keys, "component"]
    moved, cuts = merged_colours(*region_graph(cells, keys), ids, px, **rules)
    out = cells.join(moved, [*ids, "label"], "left")
    return out.select(*ids, "row", "col", F.coalesce("candidate", "label").alias("candidate"), F.coalesce("instance", "label").alias("instance")), cuts


def split_confidence(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence of a part: medium if any of its cuts is, else high."""
    ends = cuts.select(*keys, "confidence", F.explode(F.array("a", "b")).alias("instance"))
    return ends.groupBy(*keys, "instance").agg(F.when(F.bool_or(F.col("confidence") == "medium"), "medium").otherwise("high").alias("split_confidence"))


def flood_levels(cells: DataFrame, keys: list[str], levels: int = 16) -> DataFrame:
    """Adds ``level``: index of the smallest of the component's gradient quantiles that admits
    the cell (equal quantiles count once)."""
    from gridfold.operators.order import exact_percentiles
    q = exact_percentiles(cells, [*keys, "component"], "grad", [i / levels for i in range(1, levels + 1)])
    q = q.withColumn("q", F.array_sort(F.array_distinct("q")))
    return cells.join(q, [*keys, "component"]).withColumn("level", F.size(F.filter("q", lambda v: v < F.col("grad")))).drop("q")


def hybrid_partition(mask: DataFrame, instances: DataFrame, keys: list[str], px: float, min_seed: float = 10.0, tile: int = TILE) -> DataFrame:
    """Partition mask components by candidate instances: seeds = instance cells on the mask,
    seeds below ``min_seed`` m2 dropped; components with at most one seed stay whole.
    Output ``row, col, component, label`` (label NULL for whole components)."""
    comp = cut(cell_components(mask, keys, tile))
    seeds = comp.join(instances.select(*keys, "row", "col", F.col("instance").alias("seed")), [*keys, "row", "col"])
    big = seeds.groupBy(*keys, "seed").agg(F.count("*").alias("n")).where(F.col("n") * (px * px) >= min_seed - 1e-9).select(*keys, "seed")
    seeds = cut(seeds.join(big, [*keys, "seed"], "left_semi"))
    many = seeds.groupBy(*keys, "component").agg(F.count_distinct("seed").alias("k")).where("k > 1").select(*keys, "component")
    todo = comp.join(many, [*keys, "component"], "left_semi").join(seeds.select(*keys, "row", "col", "seed"), [*keys, "row", "col"], "left")
    grown = grow(todo.withColumn("level", F.lit(0)), keys, tile)
    return comp.join(grown, [*keys, "row", "col"], "left")


def merge_unaccepted(labels: DataFrame, cuts: DataFrame, keys: list[str], label: str = "instance") -> DataFrame:
    """Merge every pair whose cut is not accepted; the smallest id of a group survives."""
    edges = cuts.where("status <> 'accepted'").select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
    roots = graph_components(edges, keys).withColumnRenamed("node", label)
    return labels.join(roots, [*keys, label], "left").withColumn("merged", F.coalesce("root", label)).drop("root")


def outline_runs(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Outline of every label as directed unit edges with the region on the left:
    ``keys, label, x1, y1, x2, y2``."""
    # neighbour offset and the edge's start and end relative to the cell corner
    sides = [(-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0)]
    side = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "ax", "ay", "bx", "by"), s)]) for s in sides])
    here = labels.select(*keys, F.col(label).alias("label"), "row", "col", F.explode(side).alias("m"))
    here = here.withColumn("nr", F.col("row") + F.col("m.dr")).withColumn("nc", F.col("col") + F.col("m.dc"))
    other = labels.select(*keys, F.col(label).alias("label"), F.col("row").alias("nr"), F.col("col").alias("nc"))
    rim = here.join(dealt(other), [*keys, "label", "nr", "nc"], "left_anti")
    return rim.select(*keys, "label", (F.col("col") + F.col("m.ax")).alias("x1"), (F.col("row") + F.col("m.ay")).alias("y1"),
                      (F.col("col") + F.col("m.bx")).alias("x2"), (F.col("row") + F.col("m.by")).alias("y2"))


def stitch(x1, y1, x2, y2) -> list[list[tuple[int, int]]]:
    """Close directed unit edges to rings; at a corner where two cells meet only diagonally the
    ring turns left, so diagonal cells stay apart.  Straight runs are merged."""
    out: dict = {}
    for a, b, c, d in zip(x1, y1, x2, y2):
        out.setdefault((a, b), []).append((c, d))
    rings = []
    while out:
        start = min(out)
        path, here, came = [start], start, None
        while True:
            ways = out[here]
            if len(ways) > 1 and came is not None:
                dx, dy = here[0] - came[0], here[1] - came[1]
                ways.sort(key=lambda w: -(dx * (w[1] - here[1]) - dy * (w[0] - here[0])))
            nxt = ways.pop(0)
            if not ways:
                del out[here]
            came, here = here, nxt
            if here == start:
                break
            path.append(here)
        n = len(path)
        keep = [p for i, p in enumerate(path) if (path[i - 1][0] - p[0]) * (path[(i + 1) % n][1] - p[1]) != (path[i - 1][1] - p[1]) * (path[(i + 1) % n][0] - p[0])]
        rings.append([*keep, keep[0]])
    return rings


def stitch_all(region, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``stitch`` for the edges of many regions (numbered from 0 in ``region``): the region and the number of points of every
    ring, the points' x and y.  Rings come by region and smallest corner.

    At every corner the next edge is known beforehand, so rings are the cycles of one permutation of the edges.
    """
    n = len(region)
    x, y, r = np.concatenate([x1, x2]), np.concatenate([y1, y2]), np.concatenate([region, region])
    order = np.lexsort((y, x, r))
    fresh = np.zeros(2 * n, np.int64)
    fresh[1:] = (np.diff(r[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    corner = np.empty(2 * n, np.int64)
    corner[order] = np.cumsum(fresh)  # corners by region, x, y
    by = np.argsort(corner[:n], kind="stable")
    ways = np.bincount(corner[:n], minlength=corner.max(initial=-1) + 1)
    first = (np.cumsum(ways) - ways)[corner[n:]]
    one, two = by[first], by[np.minimum(first + 1, n - 1)]
    turn = lambda e: (x2 - x1) * (y2 - y1)[e] - (y2 - y1) * (x2 - x1)[e]
    after = np.where((ways[corner[n:]] > 1) & (turn(two) > turn(one)), two, one).tolist()
    seen, path, starts = bytearray(n), [], []
    for e in by.tolist():
        if not seen[e]:
            starts.append(len(path))
            while not seen[e]:
                seen[e] = 1
                path.append(e)
                e = after[e]
    path, starts = np.array(path, np.int64), np.array(starts, np.int64)
    ends = np.append(starts[1:], n)
    ring = np.repeat(np.arange(len(starts)), ends - starts)
    before = np.arange(n) - 1
    before[starts] = ends - 1
    dx, dy = (x2 - x1)[path], (y2 - y1)[path]
    bent = np.flatnonzero(dx[before] * dy != dy[before] * dx)  # straight runs are merged
    many = np.bincount(ring[bent], minlength=len(starts))
    head = np.cumsum(many) - many
    again = np.insert(bent, head + many, bent[head]) if len(bent) else bent
    return region[path[starts]], many + 1, x1[path[again]], y1[path[again]]


def polygonize(labels: DataFrame, keys: list[str], res: float, label: str = "label", min_area: float = 0.0) -> DataFrame:
    """Region outlines as ring arrays in metres (outer rings counter-clockwise, holes clockwise):
    ``keys, label, rings``.  Regions below ``min_area`` are dropped before any stitching.

    Edges are sorted by region and stitched as they come, many regions at once; only the outline of one region has to fit a task.
    """
    big = labels.groupBy(*keys, label).agg(F.count("*").alias("_n")).where(F.col("_n") * res * res >= min_area - 1e-9).select(*keys, label)
    edges = outline_runs(labels.join(dealt(big), [*keys, label], "left_semi"), keys, label)
    names = [*keys, "label"]

    def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        heads = _heads(batch, names)
        region = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, batch.num_rows)))
        own, many, x, y = stitch_all(region, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x1", "y1", "x2", "y2")))
        points = pa.StructArray.from_arrays([pa.array(x * res), pa.array(y * res)], ["x", "y"])
        ends = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        rings = pa.ListArray.from_arrays(ends(np.bincount(own, minlength=len(heads))), pa.ListArray.from_arrays(ends(many), points))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(heads)) for c in names), rings], [*names, "rings"])

    def close(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).combine_chunks().to_batches()[0] if held else batch
            heads = _heads(edge, names) - (1 if held else 0)
            last = int(heads[-1])  # where the last region of the batch begins, below 0: before it
            if last > 0 or (held and last == 0):
                yield closed([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(max(last, 0)))
        if held:
            yield closed(held)

    rows = edges.repartition(*names).sortWithinPartitions(*names)
    return rows.mapInArrow(close, _schema(edges, names) + ", rings array<array<struct<x:double,y:double>>>")


def _heads(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Places where a new combination of the sorted columns ``names`` begins."""
    fresh = np.zeros(batch.num_rows, bool)
    fresh[:1] = True
    for c in names:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def class_polygons(cells: DataFrame, keys: list[str], klass: str, score: Column, res: float, min_area: float, tile: int = TILE, width: int = 1 << 31) -> DataFrame:
    """One polygon for each 4-connected region of one class: ``keys, klass, component, cells, score, rings``.
    ``score`` is averaged over the region's cells; regions below ``min_area`` m2 are dropped first."""
    own = [*keys, klass]
    lab = cut(cell_components(cells, own, tile, width=width).join(dealt(cells.withColumn("_s", score).select(*own, "row", "col", "_s")), [*own, "row", "col"]))
    stats = lab.groupBy(*own, "component").agg(F.count("*").alias("cells"), F.avg("_s").alias("score"))
    return stats.join(dealt(polygonize(lab.drop("_s"), own, res, "component", min_area).withColumnRenamed("label", "component")), [*own, "component"])


def boundary_edges(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Unit edges between different labels with their geometry: ``keys, a, b, x1, y1, x2, y2``."""
    e = outline_runs(labels, keys, label)
    k = [F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2")]
    flat = e.select(*keys, "label", *k)
    return (flat.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"))
            .where("n = 2 and a <> b").drop("n"))


def boundary_lines(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Boundary of each touching pair as ordered lines: ``keys, a, b, first, second, pos, x, y, along, corner``.

    Lines run between the points where a pair's boundary ends or meets itself, closed ones start at
    their smallest point (by row, then column).  Vertices are cell corners in cell units;
    those that are no ``corner`` lie straight between their neighbours.
    """
    code = lambda x, y: F.col(y).cast("long") * (1 << 31) + F.col(x)
    pair = [*keys, "a", "b"]
    edges = boundary_edges(labels, keys, label).select(*pair, code("x1", "y1").alias("u"), code("x2", "y2").alias("v"))
    at = line_vertices(ordered_lines(edges, pair), pair)
    straight = F.coalesce(F.col("node") - F.col("behind") == F.col("ahead") - F.col("node"), F.lit(False))
    return at.select(*pair, "first", "second", "pos", F.expr("cast(node % 2147483648 as int)").alias("x"), F.shiftright("node", 31).cast("int").alias("y"), "along", (~straight).alias("corner"))


def chroma(cells: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """Brightness-free colour: channel / (sum + 3)."""
    s = F.col(r) + F.col(g) + F.col(b) + 3
    return cells.withColumn("cr", F.col(r) / s).withColumn("cg", F.col(g) / s)


def smooth_chroma(cells: DataFrame, keys: list[str], rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """5x5 median of both chroma bands and the Sobel gradient of the result: ``cr, cg, grad``.
    The frame mirrors (edge cell repeated); missing cells are skipped by the median and count
    as the centre value in the gradient."""
    src = with_halo(cells.select(*keys, "row", "col", "cr", "cg"), tile, 6)

    def mirror(i, n):
        i = np.where(i < 0, -1 - i, i)
        return np.where(i >= n, 2 * n - 1 - i, i)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - 6, int(pdf["_tc"].iloc[0]) * tile - 6
        n = tile + 12
        rr, cc = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        total = np.zeros((n, n))
        present = np.zeros((n, n), bool)
        present[rr, cc] = True
        smooth = {}
        at_r, at_c = mirror(np.arange(n) + r0, rows) - r0, mirror(np.arange(n) + c0, cols) - c0
        inside_r, inside_c = (at_r >= 0) & (at_r < n), (at_c >= 0) & (at_c < n)

        def look(grid):
            got = grid[np.clip(at_r, 0, n - 1)][:, np.clip(at_c, 0, n - 1)]
            return np.where(inside_r[:, None] & inside_c[None, :], got, np.nan)

        with np.errstate(all="ignore"):
            import warnings
            warnings.simplefilter("ignore")
            for band in ("cr", "cg"):
                grid = np.full((n, n), np.nan)
                grid[rr, cc] = pdf[band].to_numpy()
                wide = look(grid)
                stack = np.stack([np.roll(wide, (dy, dx), (0, 1)) for dy in range(-2, 3) for dx in range(-2, 3)])
                mid = np.where(present, np.nanmedian(stack, axis=0), np.nan)
                smooth[band] = mid
                wide = look(mid)

                def near(dy, dx):
                    v = np.roll(wide, (-dy, -dx), (0, 1))
                    return np.where(np.isnan(v), mid, v)
                gy = sum(w * (near(1, dx) - near(-1, dx)) for dx, w in ((-1, 1), (0, 2), (1, 1)))
                gx = sum(w * (near(dy, 1) - near(dy, -1)) for dy, w in ((-1, 1), (0, 2), (1, 1)))
                total += np.hypot(gy, gx)
        own = pdf["_own"].to_numpy()
        out = pdf.loc[own, [*keys, "row", "col"]].copy()
        out["cr"], out["cg"], out["grad"] = smooth["cr"][rr, cc][own], smooth["cg"][rr, cc][own], total[rr, cc][own] / 8.0
        return out

    return src.groupBy(*keys, "_tr", "_tc").applyInPandas(run, _schema(cells, [*keys, "row", "col"]) + ", cr double, cg double, grad double")


def component_stats(comp: DataFrame, keys: list[str], prob: Column) -> DataFrame:
    """Size and mean probability of each component (``total`` and ``n`` columns summed)."""
    return comp.groupBy(*keys, "component").agg(F.count("*").alias("cells"), F.avg(prob).alias("mean_prob"))
