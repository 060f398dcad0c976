"""Known answers for pixel and object scores."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.operators import classify as L
from gridfold.operators import scoring as C
from gridfold.operators import spans as S
from tests.test_geometry import box


def pieces(spark, boxes, res=0.5, window=0):
    d = spark.createDataFrame([(0, window, i, b) for i, b in enumerate(boxes)], "site_id int, window_id int, id long, rings array<array<struct<x:double,y:double>>>")
    return S.coverage(d, res).withColumn("part", F.lit(0).cast("long"))


def window(spark, cells=40):
    return spark.createDataFrame([(0, 0, 0, cells, 0, cells)], "site_id int, window_id int, r0 int, r1 int, k0 int, k1 int")


def counts(spark, ignore=(), nodata=None):
    lab, prd = pieces(spark, [box(0, 0, 10, 10)]), pieces(spark, [box(5, 0, 15, 10)])
    ign = pieces(spark, list(ignore) or [box(30, 30, 30, 30)])
    return C.pixel_counts(lab, prd, ign, window(spark), nodata).first()


def test_pixel_counts(spark):
    r = counts(spark)
    assert (r.tp, r.fp, r.fn, r.eval_px) == (200, 200, 200, 1600)
    r = counts(spark, [box(10, 0, 15, 10)])
    assert (r.fp, r.eval_px) == (0, 1400)
    bad = spark.range(40).selectExpr("0 site_id", "0 window_id", "cast(id as int) row", "20 c0", "40 c1")
    r = counts(spark, nodata=bad)
    assert (r.tp, r.fp, r.fn) == (200, 0, 200)


def test_ignored_share_is_strict(spark):
    prd = pieces(spark, [box(0, 0, 10, 10), box(0, 0, 9, 10)])
    kept = C.drop_ignored(prd, pieces(spark, [box(5, 0, 10, 10)])).select("id").collect()
    assert sorted(r.id for r in kept) == [0, 1]
    kept = C.drop_ignored(prd, pieces(spark, [box(4.5, 0, 10, 10)])).select("id").collect()
    assert [r.id for r in kept] == [1]


@pytest.mark.parametrize("shift,n", [(4, 0), (3, 2)])
def test_greedy_boxes(spark, shift, n):
    lab = pieces(spark, [box(0, 0, 10, 10), box(0, 20, 10, 30)])
    prd = pieces(spark, [box(shift, 0, 10 + shift, 10), box(shift, 20, 10 + shift, 30)])
    assert C.greedy_match(C.candidate_matches(lab, prd)).count() == n


def test_greedy_equals_sequential_scan(spark):
    rng = np.random.default_rng(7)
    rows = [(w, int(p), int(q), float(rng.integers(5, 10)) / 10) for w in range(12) for p, q in {(int(a), int(b)) for a, b in rng.integers(0, 9, (25, 2))}]
    d = spark.createDataFrame(rows, "window_id int, pred long, label long, iou double")
    got = {(r.window_id, r.pred, r.label) for r in C.greedy_match(d, ["window_id"]).collect()}
    want, used = set(), set()
    for w, p, q, i in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if (w, "p", p) not in used and (w, "q", q) not in used:
            used |= {(w, "p", p), (w, "q", q)}
            want.add((w, p, q))
    assert got == want


def test_optimal_matching_against_permutations(spark):
    rng = np.random.default_rng(11)
    rows = []
    for w in range(8):
        for p in range(4):
            for q in range(5):
                if rng.random() < 0.5:
                    rows.append((w, p, 100 + q, float(rng.integers(50, 100)) / 100))
    d = spark.createDataFrame(rows, "window_id int, pred long, label long, iou double")
    got = {r.window_id: (r.n, round(r.s, 6)) for r in C.optimal_match(d, ["window_id"]).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("iou").alias("s")).collect()}
    for w in range(8):
        val = {(p, q): i for ww, p, q, i in rows if ww == w}
        best = (0, 0.0)
        for perm in itertools.permutations(range(100, 105), 4):
            hit = [val[p, q] for p, q in enumerate(perm) if (p, q) in val]
            best = max(best, (len(hit), sum(hit)))
        assert got.get(w, (0, 0.0)) == (best[0], round(best[1], 6))


def test_confusion_and_scores(spark):
    d = spark.createDataFrame([("t", 0, 0), ("t", 1, 1), ("t", 1, 0), ("t", 255, 0)], "k string, ref int, pred int")
    m = C.confusion(d, spark.range(2).select(F.col("id").cast("int").alias("class_id")), ["k"])
    assert m.agg(F.sum("n")).first()[0] == 3
    r = {x.class_id: x for x in C.class_scores(m, ["k"]).collect()}
    assert r[1].recall == 0.5 and r[1].precision == 1.0
    bad = C.confusion(d.union(spark.createDataFrame([("t", 7, 0)], d.schema)), spark.range(2).select(F.col("id").cast("int").alias("class_id")), ["k"])
    assert bad.where("not valid").count() == 1


def test_boundary_scores(spark):
    from gridfold.functions import measures as M
    d = spark.createDataFrame([(0, box(0, 0, 10, 10), box(0, 0, 10, 10)), (1, box(0, 0, 10, 10), [])], "i int, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    d = d.select("i", M.segments(F.col("a")).alias("ref"), M.segments(F.col("b")).alias("pred"))
    r = {x.i: x for x in C.boundary_scores(d, 0.3, 0.1).collect()}
    assert r[0].boundary_precision == pytest.approx(1) and r[0].boundary_recall == pytest.approx(1) and r[0].hausdorff == 0
    assert r[1].boundary_precision is None and r[1].hausdorff is None


def test_classifier_abstains(spark):
    rows = [("train", "a", 1.0, 10.0), ("train", "a", 1.2, 11.0), ("train", "b", 9.0, 50.0), ("train", "b", 9.4, 52.0),
            ("evaluation", "x", 1.1, 10.5), ("evaluation", "y", 500.0, 900.0), ("evaluation", "z", None, 1.0)]
    d = spark.createDataFrame(rows, "split string, use_label string, f0 double, f1 double")
    out = {r.use_label: r.suggestion for r in L.predict(d.where("split = 'evaluation'"), L.fit(d, ["f0", "f1"]), ["f0", "f1"]).collect()}
    assert out == {"x": "a", "y": "unknown", "z": "unknown"}


def test_bits_of_overlapping_layers(spark):
    """Layers that overlap themselves, across buckets of 64 columns and left of column 0, against sets of cells."""
    rng = random.Random(4)
    cells = lambda spans: {(r, c) for r, a, b in spans for c in range(a, b)}
    layers = {n: [(rng.randint(-3, 40), c, c + rng.randint(1, 150)) for c in (rng.randint(-130, 200) for _ in range(30))] for n in ("lab", "pred", "skip")}
    frames = {n: spark.createDataFrame([(0, *s) for s in rows], "k int, row int, c0 int, c1 int") for n, rows in layers.items()}
    got = {n: set() for n in layers}
    for r in S.bit_rows(frames, ["k"]).collect():
        for n in layers:
            got[n] |= {(r.row, r.bucket * 64 + i) for i in range(64) if r[n] >> i & 1}
    assert got == {n: cells(rows) for n, rows in layers.items()}
    pieces = [(0, i, [(r, c, c + rng.randint(1, 90)) for r, c in ((rng.randint(-3, 40), rng.randint(-130, 200)),) for r in range(r, r + 20)]) for i in range(20)]
    d = spark.createDataFrame(pieces, "k int, id int, spans array<struct<row:int,c0:int,c1:int>>")
    have = {r.id: r.covered for r in S.covered_cells(d, frames["skip"], ["k"], ["k", "id"]).collect()}
    want = {i: len(cells(s) & cells(layers["skip"])) for _, i, s in pieces}
    assert have == {i: n for i, n in want.items() if n}
