"""Merging of region graphs against one merge at a time over plain tables."""
import random
from math import hypot, pi, sqrt

import pytest

from gridfold.operators import merging as M

IDS = ["site"]


def planar(dice, side, flat):
    """A grid of regions with random sizes, colours and borders; ``flat`` lets many of them tie."""
    nodes, pairs, at = {}, {}, lambda r, c: 10 + 7 * (r * side + c) % 1009
    for r in range(side):
        for c in range(side):
            n = dice.choice([2, 3, 8, 9, 30, 200])
            nodes[at(r, c)] = [n, n * dice.choice([.1, .12, .3, .32, .5]) if flat else n * dice.random(), n * dice.choice([.2, .4]), dice.choice([0, 1, 4, 9]), 0]
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < side and c + dc < side and dice.random() < .9:
                    a, b = sorted((at(r, c), at(r + dr, c + dc)))
                    e = dice.choice([1, 2, 4])
                    pairs[a, b] = [e, dice.choice([0, e]), dice.randrange(e + 1)]
    for (a, b), (e, _, _) in pairs.items():
        for k in (a, b):
            nodes[k][4] += e
    for v in nodes.values():
        v[4] += v[3]
    return nodes, pairs


def join(nodes, pairs, gone, keep):
    inner = pairs.pop((min(gone, keep), max(gone, keep)))
    nodes[keep] = [x + y for x, y in zip(nodes[keep], nodes.pop(gone))]
    nodes[keep][4] -= 2 * inner[0]
    for p in [p for p in pairs if gone in p]:
        v, o = pairs.pop(p), p[0] if p[1] == gone else p[1]
        k = (min(keep, o), max(keep, o))
        pairs[k] = [x + y for x, y in zip(v, pairs.get(k, [0, 0, 0]))]


def slow_back(nodes, pairs, min_part, neck):
    nodes, pairs, owner = {k: list(v) for k, v in nodes.items()}, dict(pairs), {k: k for k in nodes}
    while True:
        best = None
        for (a, b), (e, across, _) in pairs.items():
            area = min(nodes[a][0], nodes[b][0])
            limit = neck * 2 * sqrt(area / pi)
            if area < min_part or e > limit:
                key = (-(area < min_part), -(e / limit), across == 0, a, b)
                best = key if best is None else min(best, key)
        if best is None:
            return owner
        a, b = best[3:]
        join(nodes, pairs, b, a)
        owner = {k: a if v == b else v for k, v in owner.items()}


def slow_colours(nodes, pairs, min_part, min_outer, min_contrast, min_support):
    nodes, pairs, owner, candidate = {k: list(v) for k, v in nodes.items()}, dict(pairs), {k: k for k in nodes}, None
    gap = lambda a, b: hypot(*(nodes[a][i] / nodes[a][0] - nodes[b][i] / nodes[b][0] for i in (1, 2)))
    while True:
        touching = {k for p in pairs for k in p}
        weak = [(nodes[k][0], k) for k in touching if nodes[k][0] < min_part or nodes[k][3] / max(nodes[k][4], 1) < min_outer]
        if weak:
            gone = min(weak)[1]
            keep = min((gap(gone, o), o) for p in pairs if gone in p for o in p if o != gone)[1]
        else:
            candidate = candidate or dict(owner)
            faint = [(gap(a, b) / min_contrast + s / e / min_support, a, b) for (a, b), (e, _, s) in pairs.items() if gap(a, b) < min_contrast or s / e < min_support]
            if not faint:
                return candidate, owner, {(a, b): (gap(a, b), s / e, e) for (a, b), (e, _, s) in pairs.items()}
            _, a, b = min(faint)
            gone, keep = (a, b) if nodes[a][0] <= nodes[b][0] else (b, a)
        join(nodes, pairs, gone, keep)
        owner = {k: keep if v == gone else v for k, v in owner.items()}


def tables(spark, graphs):
    n = spark.createDataFrame([(s, k, *v) for s, (nodes, _) in graphs.items() for k, v in nodes.items()],
                              "site int, label long, cells long, sum_r double, sum_g double, outer long, perimeter long")
    p = spark.createDataFrame([(s, a, b, *v) for s, (_, pairs) in graphs.items() for (a, b), v in pairs.items()], "site int, a long, b long, edges long, across long, strong long")
    return n, p


@pytest.mark.parametrize("most", [10_000, 0])
def test_constrictions(spark, most):
    dice = random.Random(3)
    graphs = {s: planar(dice, 3 + s, s % 2 == 0) for s in range(5)}
    n, p = tables(spark, graphs)
    for min_part, neck in ((4.0, .5), (0.0, .2)) if most else ((4.0, .3),):
        got = {}
        for r in M.merged_constrictions(n, p, IDS, 1.0, min_part, neck, most).collect():
            got.setdefault(r.site, {})[r.label] = r.final
        for s, (nodes, pairs) in graphs.items():
            want = slow_back(nodes, pairs, min_part, neck)
            assert {k: got.get(s, {}).get(k, k) for k in nodes} == want


@pytest.mark.parametrize("most", [10_000, 0])
def test_colours(spark, most):
    dice = random.Random(4)
    graphs = {s: planar(dice, 3 + s, s % 2 == 0) for s in range(4)}
    n, p = tables(spark, graphs)
    for rules in ((4.0, .25, .04, .3), (3.0, .05, .15, .2))[:2 if most else 1]:
        moved, cuts = M.merged_colours(n, p, IDS, 1.0, *rules, most=most)
        got, left = {}, {}
        for r in moved.collect():
            got.setdefault(r.site, {})[r.label] = (r.candidate, r.instance)
        for r in cuts.collect():
            left.setdefault(r.site, {})[r.a, r.b] = (r.contrast, r.edge_support, r.boundary_m, r.confidence)
        for s, (nodes, pairs) in graphs.items():
            candidate, final, cut = slow_colours(nodes, pairs, *rules)
            assert {k: got.get(s, {}).get(k, (k, k)) for k in nodes} == {k: (candidate[k], final[k]) for k in nodes}
            assert {k: v[1:] for k, v in left.get(s, {}).items()} == {k: (pytest.approx(v[1], abs=6e-4), float(v[2]), "high" if v[0] >= 2 * rules[2] and v[1] >= .5 else "medium") for k, v in cut.items()}
            assert all(left[s][k][0] == pytest.approx(v[0], abs=6e-5) for k, v in cut.items())


def test_far_apart_faults_are_clusters_of_their_own(spark):
    """A chain of sound regions with a small one here and there: clusters stay small, whatever the chain's length."""
    size = [1 if i % 20 == 10 else 900 for i in range(2000)]
    n = spark.createDataFrame([(0, i, s) for i, s in enumerate(size)], "site int, label long, cells long")
    p = spark.createDataFrame([(0, i, i + 1, 3, 0) for i in range(1999)], "site int, a long, b long, edges long, across long")
    biggest = M.constriction_clusters(n, p, IDS, 1.0, 4.0, .5).groupBy("cluster").count().agg({"count": "max"}).first()[0]
    assert biggest == 3
    got = {r.label: r.final for r in M.merged_constrictions(n, p, IDS, 1.0, 4.0, .5, most=100).collect()}
    want = {k: v for k, v in slow_back({i: [s, 0, 0, 0, 0] for i, s in enumerate(size)}, {(i, i + 1): [3, 0, 0] for i in range(1999)}, 4.0, .5).items() if v != k}
    assert {k: v for k, v in got.items() if k != v} == want


def test_many_regions_in_one_group_take_no_square(spark):
    import pandas as pd
    n = 60_000
    nodes = pd.DataFrame({"label": range(n), "cells": [1] * n})
    pairs = pd.DataFrame({"a": range(n - 1), "b": range(1, n), "edges": [1] * (n - 1), "across": [1] * (n - 1)})
    assert set(M.merge_back(nodes, pairs, 1.0, 1e9, .5).values()) == {0}
