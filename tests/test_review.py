"""Review log rules against plain folds, batch and streaming."""
import numpy as np
from pyspark.sql import functions as F

from gridfold.operators import quality as Q
from gridfold.operators import review as V


def test_hot_site_write_check_equals_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i + 1, int(max(0, (i // 4) + rng.integers(-2, 3)))) for i in range(2000)] + [(1, i + 1, 0) for i in range(300)] + [(2, 1, 5)]
    d = spark.createDataFrame(rows, "site_id int, arrival long, expected long")
    got = {(r.site_id, r.arrival): r.accepted for r in V.accept_writes(d, ["site_id"], "arrival", "expected", F.floor(F.col("arrival") / 50)).collect()}
    cur = {}
    for s, a, e in rows:
        ok = cur.get(s, 0) == e
        assert got[s, a] == ok
        cur[s] = cur.get(s, 0) + ok


def test_snapshot_keeps_old_geometry(spark):
    rows = [(0, 1, 1, 100), (0, 1, 2, 120), (0, 1, 3, None), (0, 2, 4, 50)]
    ev = spark.createDataFrame(rows, "site_id int, feature int, revision int, after int")
    assert [r.after for r in V.snapshot(ev, 1, ["site_id", "feature"]).collect()] == [100]
    assert [r.after for r in V.snapshot(ev, 2, ["site_id", "feature"]).collect()] == [120]
    assert V.snapshot(ev, 3, ["site_id", "feature"]).count() == 0
    same = V.snapshot(ev, 2, ["site_id", "feature"])
    assert V.diff(same, same, ["site_id", "feature"]).count() == 0


def test_lineage_of_merged_and_split_features(spark):
    e = spark.createDataFrame([(10, 1), (10, 2), (20, 10), (21, 10), (30, 21), (30, 3)], "child long, parent long")
    got = sorted((r.child, r.source) for r in V.lineage_sources(e).collect())
    assert got == [(10, 1), (10, 2), (20, 1), (20, 2), (21, 1), (21, 2), (30, 1), (30, 2), (30, 3)]


def test_strict_and_inclusive_buffers(spark):
    d = spark.createDataFrame([("a", 1, "train", 0.0, 0.0, 10.0, 10.0), ("a", 2, "evaluation", 30.0, 0.0, 40.0, 10.0)], "site_id string, id long, split string, xmin double, ymin double, xmax double, ymax double")
    assert Q.split_leaks(d, ["site_id"], 20.0, False, 64.0).count() == 0
    assert Q.split_leaks(d, ["site_id"], 20.0, True, 64.0).count() == 1


def test_check_goes_stale_after_an_edit(spark):
    rows = [(0, 1, 1, "draw", 7), (0, 1, 2, "check", 0), (0, 2, 3, "draw", 7), (0, 2, 4, "check", 0), (0, 2, 5, "edit", 8), (0, 3, 6, "check", 0)]
    ev = spark.createDataFrame(rows, "site_id int, feature int, revision int, op string, k int")
    out = V.bound_checks(ev, ["site_id", "feature"], F.col("op") == "check", F.col("op").isin("draw", "edit"), "k")
    assert {r.feature: r.state for r in out.collect()} == {1: "current", 2: "stale", 3: "unbound"}


def test_streamed_gate_across_batches(spark):
    from gridfold.streaming import review as T
    rows = [(i + 1, s, (i // 3)) for i in range(30) for s in (0, 1)]
    d = spark.createDataFrame(rows, "arrival long, site_id long, expected long")
    got = {(r.site_id, r.arrival): r.accepted for r in T.gated_writes(spark, T.stream_of(spark, d, batches=3, files=2)).collect()}
    cur = {0: 0, 1: 0}
    for a, s, e in rows:
        assert got[s, a] == (cur[s] == e)
        cur[s] += cur[s] == e
