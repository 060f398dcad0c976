"""What an explode or an array makes large is not collected on the driver, however small its file."""
import random

import pytest
from pyspark.sql import functions as F

from gridfold.operators import pairs as P
from gridfold.operators import parcels as A
from gridfold.operators import scoring as C
from gridfold.operators import spans as S
from gridfold.operators import topology as O
from gridfold.operators import validity as V
from gridfold.operators.components import cell_components
from gridfold.plans import parcels, quality, regions, scoring, topology
from gridfold.session import cut, spread

FOLDER = "/root/testdata/sf0.001"
FEATURES = "site_id int, feature_type string, feature_id long, rings array<array<struct<x:double,y:double>>>"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def square(x, y, side=2.0):
    return [[{"x": x + a * side, "y": y + b * side} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layer") / "features.parquet")  # only of files does the planner know a size
    spark.createDataFrame([(0, "b", i, square(3.0 * i, 0.0)) for i in range(4)], FEATURES).write.parquet(path)
    return spark.read.parquet(path)


def test_pairs(layer):
    d = S.coverage(layer, 0.1).withColumnRenamed("feature_id", "id").select("site_id", "id", "spans", "cells")
    assert "BroadcastHashJoin" not in planned(P.overlap_pairs(d, d, ["site_id"]))
    assert "BroadcastHashJoin" not in planned(O.pair_relations(layer, 0.1))
    zone = S.union_spans(S.explode_spans(d, "site_id"), ["site_id"])
    assert "BroadcastHashJoin" not in planned(S.overlap_with(S.explode_spans(d, "site_id", "id"), zone, ["site_id"], ["site_id", "id"]))
    assert "BroadcastHashJoin" not in planned(P.neighbour_counts(layer.select("site_id", "feature_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), ["site_id"], "feature_id", 3.0))


def test_lines(spark, layer):
    d = layer.select("site_id", "feature_id", S.M.segments(F.col("rings")).alias("segs"))
    roads = spark.createDataFrame([(0, 0.0, -7.0, 20.0, -7.0)], "site_id int, x1 double, y1 double, x2 double, y2 double")
    out = P.nearest_line(d, roads, ["site_id"], "feature_id", 4.0)
    assert "BroadcastHashJoin" not in planned(out) and {round(r.distance, 6) for r in out.collect()} == {7.0}


def test_polygons(layer):
    out = V.polygon_faults(layer, ["feature_id"])
    assert "BroadcastHashJoin" not in planned(out) and out.where("size(faults) > 0").isEmpty()


@pytest.mark.parametrize("query", [regions.zonal, regions.score_shares])
def test_zones(spark, query):
    assert "BroadcastHashJoin" not in planned(query(spark, FOLDER))


def test_outlines_are_covered_once(spark):
    """Coverage finds the pairs; the outlines that follow them come without it."""
    plan = planned(topology._matched_outlines(spark, FOLDER))
    assert plan.count("ArrowEvalPython") == 3  # two layers and the cells that a pair shares


def test_layer_is_not_the_small_side(spark):
    """Per site one row may be collected, never the layer with its rings and spans."""
    assert "BuildLeft" not in planned(quality.layer_checks(spark, FOLDER))


def test_gaps(spark, tmp_path):
    path = str(tmp_path / "features.parquet")  # two squares, 0.3 m apart
    spark.createDataFrame([(0, "b", i, square(2.3 * i, 0.0)) for i in range(2)], FEATURES).write.parquet(path)
    d = S.coverage(spark.read.parquet(path), 0.1).withColumnRenamed("feature_id", "id")
    out = O.gap_conflicts(d, 0.1)
    assert "BroadcastHashJoin" not in planned(out) and [(r.features, r.first_feature) for r in out.collect()] == [(2, 0)]
    layers = spark.read.parquet(path)
    assert "BroadcastHashJoin" not in planned(O.relation_summary(O.pair_relations(layers, 0.1), layers, ["site_id"]))


def test_tasks_are_bounded_by_rows(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(0, 10_000, numPartitions=1).write.parquet(path)
    out = spread(spark.read.parquet(path), "id", rows=500)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 20 and max(per) < 1000 and sum(per) == 10_000
    assert spread(spark.read.parquet(path), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scores(spark):
    """Pieces, pairs and labels of a layer are as many as its features: none of their joins is collected on the driver."""
    features, labels, win = scoring.inputs(spark, FOLDER)
    truth, ignore, pieces = C.prepare(features, labels, win, 10)
    assert "BroadcastHashJoin" not in planned(pieces) and "BroadcastHashJoin" not in planned(truth) and "BroadcastHashJoin" not in planned(ignore)
    assert "BroadcastHashJoin" not in planned(C.failure_classes(truth, pieces))
    counts = planned(C.pixel_counts(truth, pieces, ignore, win))
    assert "BroadcastHashJoin" not in counts and "Window" not in counts


def test_rings_are_sorted_by_hash(layer):
    plan = planned(O.with_neighbour_flag(layer, 0.1))
    assert "SortMergeJoin [_h#" in plan and "BroadcastHashJoin" not in plan


def test_parcels_and_predictions(spark):
    p = parcels.parcel_spans(spark, FOLDER)
    zone = parcels.zone(spark, FOLDER, 0, 650, 0, 650)
    assert "BroadcastHashJoin" not in planned(A.parcel_conflicts(p, zone, zone, ["site_id"], 1))
    assert "Window" not in planned(parcels.uncovered(spark, FOLDER))
    assert "BroadcastHashJoin" not in planned(scoring.best_prediction(spark, FOLDER))


def test_zones_are_shuffled_as_spans(spark):
    spans = spark.createDataFrame([(0, 1, 5, 60, 70), (0, 2, -3, -70, -60), (0, 3, 5, 0, 3)], "k int, zone int, row int, c0 int, c1 int")
    cells = spark.createDataFrame([(0, r, c, 100 * r + c) for r, c in ((5, 59), (5, 60), (5, 64), (5, 69), (5, 70), (-3, -65), (-3, -64), (-3, -60))], "k int, row int, col int, v int")
    got = S.under_spans(spans, cells, ["k"], "v")
    assert sorted((r.zone, r.v) for r in got.collect()) == [(1, 560), (1, 564), (1, 569), (2, -365), (2, -364)]
    plan = planned(regions.zonal(spark, FOLDER))
    assert plan.index("explode(slice(") < plan.index("SortMergeJoin")  # the plan is written from its end


def test_gaps_too_small_stay_in_their_tile(spark):
    """Small tiles find the same gaps; what lies inside a tile and is small goes, whole gaps at its border do not."""
    spans = [(0, "b", i, [(r, c, c + 5) for r in range(i * 37 % 50, i * 37 % 50 + 4)]) for i in range(40) for c in [i * 29 % 60]] + [(0, "b", 99, [])]
    d = spark.createDataFrame(spans, "site_id int, feature_type string, id long, spans array<struct<row:int,c0:int,c1:int>>")
    every = {(r.row, r.col) for r in O.closing_gaps(d, 0.1).collect()}
    assert every and every == {(r.row, r.col) for r in O.closing_gaps(d, 0.1, tile=16).collect()}
    lab = cell_components(O.closing_gaps(d, 0.1), O.KEYS).groupBy("component").agg(F.count("*").alias("n"), F.collect_list(F.struct("row", "col")).alias("cells"))
    big = {(c.row, c.col) for r in lab.where("n >= 6").collect() for c in r.cells}
    some, tiled = ({(r.row, r.col) for r in O.closing_gaps(d, 0.1, tile=t, min_area=0.06).collect()} for t in (256, 16))
    assert big <= tiled < every and big <= some < every


def test_layer_is_not_stored_with_its_rings(layer, monkeypatch):
    """The conflict table carries rings through its joins, not spans and edges, and materialises what is left of the gaps only."""
    wide = []
    monkeypatch.setattr(O, "cut", lambda df: wide.append(df.columns) or cut(df))
    out = O.conflict_table(layer, 0.1)
    assert not any("rings" in c or "spans" in c for c in wide)
    assert "BroadcastHashJoin" not in planned(out)
    tall = O.with_broken(layer.limit(1).withColumn("rings", F.array(F.concat(*[F.col("rings")[0]] * 80))))
    assert [r._broken for r in tall.collect()] == [True] and [r._broken for r in O.with_broken(layer).collect()] == [False] * 4


def test_few_lines_are_met_at_once(spark):
    """Keys with few lines and keys that are searched give the same distances; few lines copy no outline into buckets."""
    rng = random.Random(3)
    rows = [(k, i, square(rng.uniform(0, 60), rng.uniform(0, 60)), i % 3) for k in range(4) for i in range(25)]
    d = spark.createDataFrame(rows, "site_id int, feature_id long, rings array<array<struct<x:double,y:double>>>, tag int")
    d = d.select("site_id", "feature_id", "tag", S.M.segments(F.col("rings")).alias("segs"))
    lines = spark.createDataFrame([(k, *[rng.uniform(0, 60) for _ in range(4)]) for k in range(3) for _ in range(1 + 4 * k)], "site_id int, x1 double, y1 double, x2 double, y2 double")
    got = [{(r.site_id, r.feature_id): (r.tag, r.distance) for r in P.nearest_line(d, lines, ["site_id"], "feature_id", 4.0, ("tag",), few).collect()} for few in (64, 5, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 100 and {k[0] for k, v in got[0].items() if v[1] is None} == {3}
    assert "Generate" not in planned(P.nearest_line(d, lines, ["site_id"], "feature_id", 4.0))


def test_neighbours_within_wide_cells(spark):
    rng = random.Random(5)
    at = [(rng.randrange(40) / 4, rng.randrange(40) / 4 - 5) for _ in range(200)]
    d = spark.createDataFrame([(0, i, x, y, "t") for i, (x, y) in enumerate(at)], "site_id int, id long, x double, y double, tag string")
    out = P.neighbour_counts(d, ["site_id"], "id", 1.25, ("tag",)).collect()
    assert {r.id: r.neighbours for r in out} == {i: sum((x - u) ** 2 + (y - v) ** 2 <= 1.5625 for u, v in at) - 1 for i, (x, y) in enumerate(at)}
    assert {r.tag for r in out} == {"t"}


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "shuffle_" in f}


def test_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled(spark)
    out = cut(rows)
    assert shuffled(spark) <= before and out.count() == 7
    assert rows.count() == 7 and cut(rows).count() == 7  # what was cut can be computed again


def test_layer_checks_take_a_mask_in_spans(spark, layer):
    """The same results as with its cells; the layer's spans are not stored and no cell is shuffled."""
    sites = spark.createDataFrame([(0, 4)], "site_id int, features long").selectExpr("*", "0D xmin", "0D ymin", "20D xmax", "20D ymax")
    nodata = spark.createDataFrame([(0, 9, 10)], "site_id int, row int, col int")
    spans = S.explode_spans(S.coverage(layer.where("feature_id < 3"), 0.1), "site_id")
    a, b = ({r.check: r.detail for r in V.layer_checks(layer, mask, nodata, sites, ["site_id"], 0.1, 1.0).collect()} for mask in (spans, S.to_cells(spans)))
    assert a == b and a["round_trip"] == 0.75 and a["interior_points"] == 1.0
    plan = planned(quality.layer_checks(spark, FOLDER))
    assert "checkpoint" not in plan and "sequence(c0" not in plan and "Scan ExistingRDD" not in plan
