"""Merging of region graphs by priority, exact, with large components cut into independent clusters.

The rules always take the globally first candidate of a component, so the order of merges matters.
But what happens in one part of a component can only reach another through a pair that may one day
fall under the rule.  A bound that holds for every state the two sides can take on (borders and
areas only grow, means stay between the means of their members) tells such pairs apart;
the others separate clusters, and each cluster is worked off alone, by a heap whose entries are
renewed when they come up.  Components up to ``MOST`` regions are one cluster without that search.
"""
from __future__ import annotations

import heapq
from math import hypot, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.operators.components import graph_components
from gridfold.session import cut

MOST = 50_000  # regions of a component that is worked off whole


def _links(pairs, a: str, b: str, *values: str) -> dict[int, dict[int, list]]:
    near: dict[int, dict[int, list]] = {}
    for row in pairs[[a, b, *values]].itertuples(index=False):
        link = list(row[2:])
        near.setdefault(int(row[0]), {})[int(row[1])] = link  # one list for both directions
        near.setdefault(int(row[1]), {})[int(row[0])] = link
    return near


def _absorb(near: dict, gone: int, keep: int) -> list[int]:
    """Gone's borders become keep's; returns the neighbours whose border with keep is new or longer."""
    touched = []
    for other, link in near.pop(gone).items():
        del near[other][gone]
        if other == keep:
            continue
        have = near[keep].get(other)
        near[keep][other] = near[other][keep] = link if have is None else [x + y for x, y in zip(have, link)]
        touched.append(other)
    return touched


def _flat(into: dict[int, int]) -> dict[int, int]:
    for k in into:
        path, v = [k], into[k]
        while into[v] != v:
            path.append(v)
            v = into[v]
        for p in path:
            into[p] = v
    return into


def constriction_fault(edges, small, px: float, min_part: float, neck: float):
    """(too small?, border length / limit) of a pair with ``edges`` cell edges whose smaller part has ``small`` cells; None if fine."""
    area = small * px * px
    limit = neck * 2 * sqrt(area / pi)
    length = edges * px
    return (area < min_part, length / limit) if area < min_part or length > limit else None


def merge_back(parts: pd.DataFrame, edges: pd.DataFrame, px: float, min_part: float, neck: float) -> dict[int, int]:
    """Constriction rule on one region graph: part -> surviving part.

    Worst pair first: pairs with a part below ``min_part`` m2 before over-wide necks (boundary longer than
    ``neck`` x the smaller equivalent diameter); the smaller id survives.  Among equal faults pairs with a
    horizontal edge come first, then the smaller ids.
    """
    size = {int(k): int(v) for k, v in zip(parts["label"], parts["cells"])}
    near, into = _links(edges, "a", "b", "edges", "across"), {k: k for k in size}

    def entry(a: int, b: int):
        edges_, across = near[a][b]
        fault = constriction_fault(edges_, min(size[a], size[b]), px, min_part, neck)
        return fault and (-fault[0], -fault[1], across == 0, min(a, b), max(a, b))

    heap = [e for a in near for b in near[a] if a < b and (e := entry(a, b))]
    heapq.heapify(heap)
    while heap:
        was = heapq.heappop(heap)
        keep, gone = was[3:]
        now = entry(keep, gone) if gone in near.get(keep, ()) else None
        if now != was:          # areas only grow, so an entry can only be too early
            if now and now > was:
                heapq.heappush(heap, now)
            continue
        size[keep] += size.pop(gone)
        into[gone] = keep
        for other in _absorb(near, gone, keep):
            e = entry(keep, other)
            if e:
                heapq.heappush(heap, e)
    return _flat(into)


class Graph:
    """Regions with sums and borders, for the colour rules."""

    def __init__(self, nodes: pd.DataFrame, pairs: pd.DataFrame):
        self.sums = {int(r[0]): [float(x) for x in r[1:]] for r in nodes[["label", "cells", "sum_r", "sum_g", "outer", "perimeter"]].itertuples(index=False)}
        self.near = _links(pairs, "a", "b", "edges", "strong")
        self.into = {k: k for k in self.sums}

    def gap(self, a: int, b: int) -> float:
        x, y = self.sums[a], self.sums[b]
        return hypot(x[1] / x[0] - y[1] / y[0], x[2] / x[0] - y[2] / y[0])

    def merge(self, gone: int, keep: int) -> None:
        inner = self.near[gone][keep][0]
        self.sums[keep] = [x + y for x, y in zip(self.sums[keep], self.sums.pop(gone))]
        self.sums[keep][4] -= 2 * inner
        self.into[gone] = keep
        _absorb(self.near, gone, keep)

    def guard(self, smallest: float, min_outer: float) -> None:
        """Small or enclosed regions join their most similar neighbour, the smallest region first."""
        def weak(k):
            cells, _, _, outer, perimeter = self.sums[k]
            return bool(self.near.get(k)) and (cells < smallest or outer / max(perimeter, 1) < min_outer)
        heap = [(self.sums[k][0], k) for k in self.near if weak(k)]
        heapq.heapify(heap)
        while heap:
            cells, k = heapq.heappop(heap)
            if k not in self.sums or self.sums[k][0] != cells or not weak(k):
                continue
            keep = min(self.near[k], key=lambda o: (self.gap(k, o), o))
            self.merge(k, keep)
            if weak(keep):
                heapq.heappush(heap, (self.sums[keep][0], keep))

    def close_faint(self, min_contrast: float, min_support: float) -> None:
        """The faintest pair below a floor closes, the smaller region joining the larger.  Where no region
        is small or enclosed at first, none becomes so: areas grow and the share of outer border stays
        between those of the two."""
        def entry(a, b):
            gap, (edges, strong) = self.gap(a, b), self.near[a][b]
            support = strong / edges
            return (gap / min_contrast + support / min_support, min(a, b), max(a, b)) if gap < min_contrast or support < min_support else None
        heap = [e for a in self.near for b in self.near[a] if a < b and (e := entry(a, b))]
        heapq.heapify(heap)
        while heap:
            was = heapq.heappop(heap)
            _, a, b = was
            if b not in self.near.get(a, ()) or entry(a, b) != was:
                continue
            gone, keep = (a, b) if self.sums[a][0] <= self.sums[b][0] else (b, a)
            self.merge(gone, keep)
            for other in self.near[keep]:
                e = entry(keep, other)
                if e:
                    heapq.heappush(heap, e)


def per_group(graph: DataFrame, ids: list[str], fn, schema: str, rows_per_task: int = 20_000) -> DataFrame:
    """Apply ``fn`` to the graph of every group ``ids``; small groups share a Python call."""
    tasks = max(graph.sparkSession.sparkContext.defaultParallelism, graph.count() // rows_per_task)
    packed = graph.withColumn("_g", F.pmod(F.xxhash64(*ids), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fn(part) for _, part in pdf.drop(columns="_g").groupby(ids, sort=False)], ignore_index=True)

    return packed.groupBy("_g").applyInPandas(run, schema)


def _types(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def _ends(pairs: DataFrame, table: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Pairs with columns of both regions: ``x`` becomes ``x_a`` and ``x_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(*ids, F.col("label").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), [*ids, end])
    return pairs


def _joined(cluster: DataFrame, edges: DataFrame, ids: list[str]) -> DataFrame:
    """Clusters (label, cluster) united along ``edges`` (u, v: clusters)."""
    roots = graph_components(edges, ids).withColumnRenamed("node", "cluster")
    return cut(cluster.join(roots, [*ids, "cluster"], "left").select(*ids, "label", F.coalesce("root", "cluster").alias("cluster")))


def _grow_clusters(nodes: DataFrame, ids: list[str], risky) -> DataFrame:
    """Smallest clusters that no risky pair leaves; ``risky(cluster)`` gives the pairs of clusters (u, v) that
    may one day fall under the rule."""
    cluster = cut(nodes.select(*ids, "label", F.col("label").alias("cluster")))
    while True:
        edges = cut(risky(cluster))
        if edges.isEmpty():
            return cluster
        cluster = _joined(cluster, edges, ids)


def constriction_clusters(nodes: DataFrame, pairs: DataFrame, ids: list[str], px: float, min_part: float, neck: float) -> DataFrame:
    """Clusters for ``merge_back``: the border between parts of two clusters never exceeds all their borders
    together, and the smaller of two parts is never smaller than the smallest that touches."""
    sized = cut(_ends(pairs, nodes, ids, ["cells"]).select(*ids, "a", "b", "edges", F.least("cells_a", "cells_b").alias("small")))

    def risky(cluster):
        across = _ends(sized, cluster, ids, ["cluster"]).where("cluster_a <> cluster_b")
        met = across.groupBy(*ids, F.least("cluster_a", "cluster_b").alias("u"), F.greatest("cluster_a", "cluster_b").alias("v")).agg(F.sum("edges").alias("n"), F.min("small").alias("small"))
        area = F.col("small") * (px * px)
        return met.where((area < min_part) | (F.col("n") * px > neck * 2 * F.sqrt(area / pi) * (1 - 1e-9))).select(*ids, "u", "v")
    return _grow_clusters(nodes, ids, risky)


def guard_clusters(nodes: DataFrame, pairs: DataFrame, ids: list[str], smallest: float, min_outer: float) -> DataFrame:
    """Clusters for ``Graph.guard``: regions that are or may become small or enclosed, with all their neighbours.

    A region that is neither can only lose its share of outer border by what it absorbs, at most the
    touching groups of such regions whole.
    """
    shape = cut(nodes.select(*ids, "label", "outer", "perimeter", ((F.col("cells") < smallest) | (F.col("outer") / F.greatest("perimeter", F.lit(1)) < min_outer)).alias("hot")))
    while True:
        both = cut(_ends(pairs.select(*ids, "a", "b"), shape, ids, ["hot", "perimeter"]))
        inner = both.where("hot_a and hot_b").select(*ids, F.col("a").alias("u"), F.col("b").alias("v"))
        groups = _joined(shape.where("hot").select(*ids, "label", F.col("label").alias("cluster")), inner, ids)
        sums = groups.join(shape, [*ids, "label"]).groupBy(*ids, "cluster").agg(F.sum("perimeter").alias("more"))
        rim = both.where("hot_a and not hot_b").select(*ids, F.col("b").alias("cold"), F.col("a").alias("label")).unionByName(
            both.where("hot_b and not hot_a").select(*ids, F.col("a").alias("cold"), F.col("b").alias("label")))
        met = rim.join(groups, [*ids, "label"]).select(*ids, "cold", "cluster").distinct().join(sums, [*ids, "cluster"]).groupBy(*ids, F.col("cold").alias("label")).agg(F.sum("more").alias("more"))
        new = shape.join(met, [*ids, "label"]).where(F.col("outer") / (F.col("perimeter") + F.col("more")) < min_outer).select(*ids, "label", F.lit(True).alias("new"))
        new = cut(new)
        if new.isEmpty():
            edges = both.where("hot_a or hot_b").select(*ids, F.col("a").alias("u"), F.col("b").alias("v"))
            return _joined(shape.select(*ids, "label", F.col("label").alias("cluster")), edges, ids)
        shape = cut(shape.join(new, [*ids, "label"], "left").withColumn("hot", F.col("hot") | F.coalesce("new", F.lit(False))).drop("new"))


def faint_clusters(nodes: DataFrame, pairs: DataFrame, ids: list[str], min_contrast: float, min_support: float) -> DataFrame:
    """Clusters for ``Graph.close_faint``: the means of two clusters stay inside the boxes of their
    members' means, and the support of joined borders is no less than their least."""
    means = cut(nodes.select(*ids, "label", (F.col("sum_r") / F.col("cells")).alias("r"), (F.col("sum_g") / F.col("cells")).alias("g")))

    def risky(cluster):
        box = cluster.join(means, [*ids, "label"]).groupBy(*ids, F.col("cluster").alias("label")).agg(*[f(c).alias(f"{c}{n}") for c in "rg" for n, f in ((0, F.min), (1, F.max))])
        met = _ends(pairs, cluster, ids, ["cluster"]).where("cluster_a <> cluster_b").groupBy(
            *ids, F.least("cluster_a", "cluster_b").alias("a"), F.greatest("cluster_a", "cluster_b").alias("b")).agg(F.min(F.col("strong") / F.col("edges")).alias("support"))
        met = _ends(met, box, ids, ["r0", "r1", "g0", "g1"])
        apart = [F.greatest(F.lit(0.0), F.col(f"{c}0_a") - F.col(f"{c}1_b"), F.col(f"{c}0_b") - F.col(f"{c}1_a")) for c in "rg"]
        return met.where((F.hypot(*apart) < min_contrast * (1 + 1e-9)) | (F.col("support") < min_support)).select(*ids, F.col("a").alias("u"), F.col("b").alias("v"))
    return _grow_clusters(nodes, ids, risky)


def _solve(nodes: DataFrame, pairs: DataFrame, ids: list[str], cluster: DataFrame | None, fn, names: list[str]) -> DataFrame:
    """``fn(nodes, pairs)`` -> rows (label, *names) for every cluster (None: every component)."""
    if cluster is not None:
        pairs = _ends(pairs, cluster, ids, ["cluster"]).where("cluster_a = cluster_b").withColumn("cluster", F.col("cluster_a")).drop("cluster_a", "cluster_b")
        nodes = nodes.join(cluster, [*ids, "label"])
    group = ids if cluster is None else [*ids, "cluster"]
    live = pairs.select(*group).distinct()  # a cluster of one region has nothing to merge
    graph = cut(nodes.join(live, group, "left_semi").withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)), allowMissingColumns=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fn(pdf[pdf.kind == 0].astype({"label": "int64"}), pdf[pdf.kind == 1].astype({"a": "int64", "b": "int64"}))
        return pd.DataFrame(rows, columns=["label", *names]).assign(**{k: pdf[k].iloc[0] for k in ids})[[*ids, "label", *names]]

    return cut(per_group(graph, group, run, _types(nodes, [*ids, "label"]) + "".join(f", {n} long" for n in names)))


def _large(nodes: DataFrame, ids: list[str], most: int) -> DataFrame:
    return cut(nodes.groupBy(*ids).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*ids))


def contract(nodes: DataFrame, pairs: DataFrame, ids: list[str], moved: DataFrame, to: str) -> tuple[DataFrame, DataFrame]:
    """The region graph after each label became ``moved.to`` (labels not in ``moved`` stay)."""
    at = moved.select(*ids, "label", F.col(to).alias("to"))
    new = nodes.join(at, [*ids, "label"], "left").withColumn("to", F.coalesce("to", "label"))
    ends = pairs
    for end in ("a", "b"):
        ends = ends.join(at.select(*ids, F.col("label").alias(end), F.col("to").alias(f"{end}_to")), [*ids, end], "left").withColumn(f"{end}_to", F.coalesce(f"{end}_to", end))
    ends = ends.select(*ids, F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"), "edges", "strong")
    ends = ends.groupBy(*ids, "a", "b").agg(F.sum("edges").alias("edges"), F.sum("strong").alias("strong"))
    inner = ends.where("a = b").select(*ids, F.col("a").alias("label"), F.col("edges").alias("inner"))
    sums = new.groupBy(*ids, F.col("to").alias("label")).agg(*[F.sum(c).alias(c) for c in ("cells", "sum_r", "sum_g", "outer", "perimeter")])
    sums = sums.join(inner, [*ids, "label"], "left").withColumn("perimeter", F.col("perimeter") - 2 * F.coalesce("inner", F.lit(0))).drop("inner")
    return sums, ends.where("a <> b")


def merged_constrictions(nodes: DataFrame, pairs: DataFrame, ids: list[str], px: float, min_part: float, neck: float, most: int = MOST) -> DataFrame:
    """``merge_back`` over all components ``ids``: ``label, final`` of every region that has a neighbour."""
    nodes, pairs = cut(nodes.select(*ids, "label", "cells")), cut(pairs.select(*ids, "a", "b", "edges", "across"))
    fn = lambda n, p: list(merge_back(n, p, px, min_part, neck).items())
    large = _large(nodes, ids, most)
    if large.isEmpty():
        return _solve(nodes, pairs, ids, None, fn, ["final"])
    few, many = ([t.join(large, ids, how) for t in (nodes, pairs)] for how in ("left_anti", "left_semi"))
    return _solve(*few, ids, None, fn, ["final"]).unionByName(_solve(*many, ids, constriction_clusters(*many, ids, px, min_part, neck), fn, ["final"]))


def merged_colours(nodes: DataFrame, pairs: DataFrame, ids: list[str], px: float, min_part: float = 10.0, min_outer: float = 0.25,
                   min_contrast: float = 0.04, min_support: float = 0.3, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Colour-guided merging over all components ``ids``.

    Two rules: a small or enclosed region joins its most similar neighbour (smallest region first);
    when that rests (the candidates), the faintest pair below the contrast or support floor
    closes.  Returns ``label, candidate, instance`` of every region that has a neighbour, and the pairs
    that stay: ``a, b, contrast, edge_support, boundary_m, confidence``.
    """
    nodes, pairs, smallest = cut(nodes), cut(pairs), min_part / (px * px)

    def guard(n, p):
        g = Graph(n, p)
        g.guard(smallest, min_outer)
        return list(_flat(g.into).items())

    def faint(n, p):
        g = Graph(n, p)
        g.close_faint(min_contrast, min_support)
        return list(_flat(g.into).items())

    def whole(n, p):
        g = Graph(n, p)
        g.guard(smallest, min_outer)
        candidate = dict(_flat(dict(g.into)))
        g.close_faint(min_contrast, min_support)
        final = _flat(g.into)
        return [(k, candidate[k], final[k]) for k in final]

    large = _large(nodes, ids, most)
    if large.isEmpty():
        moved = _solve(nodes, pairs, ids, None, whole, ["candidate", "instance"])
    else:
        few, many = ([t.join(large, ids, how) for t in (nodes, pairs)] for how in ("left_anti", "left_semi"))
        first = _solve(*many, ids, guard_clusters(*many, ids, smallest, min_outer), guard, ["candidate"])
        mid = [cut(t) for t in contract(*many, ids, first, "candidate")]
        second = _solve(*mid, ids, faint_clusters(*mid, ids, min_contrast, min_support), faint, ["instance"]).withColumnRenamed("label", "candidate")
        all_of = many[0].select(*ids, "label").join(first, [*ids, "label"], "left").withColumn("candidate", F.coalesce("candidate", "label"))
        done = all_of.join(second, [*ids, "candidate"], "left").withColumn("instance", F.coalesce("instance", "candidate"))
        moved = _solve(*few, ids, None, whole, ["candidate", "instance"]).unionByName(done.select(*ids, "label", "candidate", "instance"))
    moved = cut(moved)
    left, cuts = contract(nodes, pairs, ids, moved, "instance")
    means = left.select(*ids, "label", (F.col("sum_r") / F.col("cells")).alias("r"), (F.col("sum_g") / F.col("cells")).alias("g"))
    gap: Column = F.hypot(F.col("r_a") - F.col("r_b"), F.col("g_a") - F.col("g_b"))
    support = F.col("strong") / F.col("edges")
    cuts = _ends(cuts, means, ids, ["r", "g"]).select(
        *ids, "a", "b", F.round(gap, 4).alias("contrast"), F.round(support, 3).alias("edge_support"), F.round(F.col("edges") * px, 1).alias("boundary_m"),
        F.when((gap >= 2 * min_contrast) & (support >= 0.5), "high").otherwise("medium").alias("confidence"))
    return moved, cuts
