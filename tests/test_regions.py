"""Region operators against plain Python twins on small scenes."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.operators import regions as R3
from gridfold.functions import measures as M
from gridfold.operators import parcels as A
from gridfold.operators import regions as G
from gridfold.operators import roads as D
from gridfold.operators.components import cell_components, graph_components
from gridfold.operators.order import exact_percentiles, number_in_order


def cells(spark, grid, k=0):
    rr, cc = np.nonzero(grid)
    return spark.createDataFrame([(k, int(r), int(c)) for r, c in zip(rr, cc)], "site_id int, row int, col int")


def plain_components(grid, eight=False):
    lab, n = np.zeros(grid.shape, int), 0
    for r, c in zip(*np.nonzero(grid)):
        if lab[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        lab[r, c] = n
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (eight or not (dy and dx)):
                        v, u = y + dy, x + dx
                        if 0 <= v < grid.shape[0] and 0 <= u < grid.shape[1] and grid[v, u] and not lab[v, u]:
                            lab[v, u] = n
                            todo.append((v, u))
    return lab


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_seams(spark, eight):
    grid = np.random.default_rng(2).random((40, 45)) < 0.55
    want = plain_components(grid, eight)
    got = {(r.row, r.col): r.component for r in cell_components(cells(spark, grid), ["site_id"], 8, eight).collect()}
    pairs = {(want[k], v) for k, v in got.items()}
    assert len(got) == grid.sum() and len(pairs) == want.max() == len({v for _, v in pairs})


def test_graph_components_long_path_and_star(spark):
    e = [(0, i, i + 1) for i in range(300)] + [(0, 1000, 1000 + i) for i in range(1, 200)] + [(1, 5, 4)]
    out = graph_components(spark.createDataFrame(e, "k int, u long, v long"), ["k"]).collect()
    roots = {(r.k, r.node): r.root for r in out}
    assert {roots[0, i] for i in range(301)} == {0} and {roots[0, 1000 + i] for i in range(200)} == {1000} and roots[1, 5] == 4


def plain_flood(region, seeds, level):
    lab = np.where(region, seeds, 0)
    for t in range(level[region].max() + 1):
        open_ = region & (level <= t)
        while True:
            pad = np.pad(lab, 1)
            near = np.max([pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]], axis=0)
            new = open_ & (lab == 0) & (near > 0)
            if not new.any():
                break
            lab[new] = near[new]
    return lab


@pytest.mark.parametrize("levels", [1, 5])
def test_growth_equals_step_by_step_form(spark, levels):
    rng = np.random.default_rng(levels)
    region = rng.random((37, 41)) < 0.75
    seeds = np.where(rng.random(region.shape) < 0.02, rng.integers(1, 50, region.shape), 0) * region
    level = rng.integers(0, levels, region.shape)
    rows = [(0, int(r), int(c), int(seeds[r, c]) or None, int(level[r, c])) for r, c in zip(*np.nonzero(region))]
    d = spark.createDataFrame(rows, "site_id int, row int, col int, seed long, level int")
    got = {(r.row, r.col): r.label or 0 for r in G.grow(d, ["site_id"], 8).collect()}
    want = plain_flood(region, seeds, level)
    assert all(want[k] == v for k, v in got.items()) and len(got) == region.sum()


def separated(spark, grid, **kw):
    out = G.separate_instances(cells(spark, grid), ["site_id"], 0.3, *grid.shape, tile=32, **kw)
    rows = out.collect()
    assert {(r.row, r.col) for r in rows} == set(map(tuple, np.argwhere(grid)))
    size = {}
    for r in rows:
        size[r.instance] = size.get(r.instance, 0) + 1
    return sorted(size.values())


def test_neck_splits_into_equal_parts(spark):
    grid = np.zeros((40, 80), bool)
    grid[5:35, 5:35] = grid[5:35, 39:69] = True
    grid[18:22, 35:39] = True
    parts = separated(spark, grid)
    assert len(parts) == 2 and parts[0] == parts[1]


def test_full_wall_and_bump_stay_whole(spark):
    grid = np.zeros((40, 80), bool)
    grid[5:35, 5:65] = True
    assert len(separated(spark, grid)) == 1
    grid = np.zeros((40, 50), bool)
    grid[5:35, 5:35] = True
    grid[18:22, 35:38] = True
    assert len(separated(spark, grid)) == 1


def guided(spark, colours, px=0.3):
    h, w = colours.shape[:2]
    s = colours.sum(-1) + 3.0
    rows = [(0, r, c, float(colours[r, c, 0] / s[r, c]), float(colours[r, c, 1] / s[r, c])) for r in range(2, h - 2) for c in range(2, w - 2)]
    d = spark.createDataFrame(rows, "site_id int, row int, col int, cr double, cg double")
    g = G.smooth_chroma(d, ["site_id"], h, w, 32)
    comp = cell_components(g, ["site_id"], 32)
    full = g.join(comp, ["site_id", "row", "col"])
    q = exact_percentiles(full, ["site_id"], "grad", [0.3, 0.75]).first().q
    full = full.withColumn("strong", F.col("grad") >= q[1])
    seeds = cell_components(full.where(F.col("grad") <= q[0]), ["site_id"], 32).withColumnRenamed("component", "seed")
    lev = G.flood_levels(full, ["site_id"]).join(seeds, ["site_id", "row", "col"], "left")
    lab = full.join(G.grow(lev, ["site_id"], 32), ["site_id", "row", "col"]).withColumn("label", F.coalesce("label", "component"))
    inst, cuts = G.guided_separation(lab, ["site_id"], px)
    return inst.select("instance").distinct().count(), cuts.collect()


def test_colour_step_is_cut_and_brightness_step_is_not(spark):
    rng = np.random.default_rng(0)
    scene = np.zeros((60, 100, 3))
    scene[:, :50] = (200, 120, 60)
    scene[:, 50:] = (150, 150, 150)
    n, cuts = guided(spark, scene + rng.normal(0, 2, scene.shape))
    assert n == 2 and [c.confidence for c in cuts] == ["high"]
    scene[:, :50] = (120, 120, 120)
    scene[:, 50:] = (200, 200, 200)
    n, cuts = guided(spark, scene + rng.normal(0, 2, scene.shape))
    assert n == 1 and cuts == []


def test_hybrid_partition(spark):
    mask = np.zeros((30, 60), bool)
    mask[5:25, 5:55] = True
    inst = spark.createDataFrame([(0, r, c, 1) for r in range(5, 25) for c in range(5, 20)] + [(0, r, c, 2) for r in range(5, 25) for c in range(35, 58)], "site_id int, row int, col int, instance long")
    out = G.hybrid_partition(cells(spark, mask), inst, ["site_id"], 0.3, tile=16)
    assert out.count() == mask.sum() and out.select("label").distinct().count() == 2
    small = inst.where("instance = 1 or (row < 10 and col < 40)")
    out = G.hybrid_partition(cells(spark, mask), small, ["site_id"], 0.3, tile=16)
    assert out.where("label is not null").count() == 0


def test_polygons_keep_diagonal_cells_apart(spark):
    grid = np.zeros((6, 6), bool)
    grid[0:4, 0:4] = True
    grid[1, 1] = grid[2, 2] = False  # two holes that touch at a corner
    d = cells(spark, grid).withColumn("label", F.lit(1).cast("long"))
    r = G.polygonize(d, ["site_id"], 1.0).select("rings", M.area(F.col("rings")).alias("a")).first()
    assert r.a == 14 and len(r.rings) in (2, 3)


def test_thinning_equals_whole_grid_form(spark):
    rng = np.random.default_rng(4)
    grid = np.zeros((50, 50), bool)
    for _ in range(6):
        r, c = rng.integers(2, 30, 2)
        grid[r:r + 6, c:c + 18] = True
    want = np.pad(grid, 2)
    while True:
        nxt = D.thin_once(want)
        if np.array_equal(nxt, want):
            break
        want = nxt
    got = {(r.row, r.col) for r in D.skeleton(cells(spark, grid), ["site_id"], 16).collect()}
    assert got == {(int(r) - 2, int(c) - 2) for r, c in np.argwhere(want)}


def test_straight_road(spark):
    grid = np.zeros((32, 32), bool)
    grid[14:17, 3:29] = True
    sk = D.skeleton(cells(spark, grid), ["site_id"], 16)
    d = D.graph_diagnostics(sk, ["site_id"], 16).first()
    assert d.components == 1 and d.endpoints == 2 and d.junctions == 0
    line = D.skeleton_edges(sk, ["site_id"]).selectExpr("site_id", "cast(col as double) x1", "cast(row as double) y1", "cast(col2 as double) x2", "cast(row2 as double) y2")
    r = D.line_coverage(line, line, ["site_id"], 1.0, 0.5).first()
    assert r.covered == pytest.approx(r.total)
    assert D.centrelines(sk, ["site_id"]).select("first", "second").distinct().count() == 1


def test_parcel_faces_and_loose_line(spark):
    lines = [(0, 1, 0, 0, 20, 0), (0, 2, 20, 0, 20, 20), (0, 3, 20, 20, 0, 20), (0, 4, 0, 20, 0, 0), (0, 5, 10, 0, 10, 20), (0, 6, 12, 10, 17, 10)]
    d = spark.createDataFrame([(s, i, *map(float, p)) for s, i, *p in lines], "site_id int, line_id long, x1 double, y1 double, x2 double, y2 double")
    walls = A.wall_edges(d, ["site_id"], 1.0)
    ext = spark.createDataFrame([(0, 0, 20, 0, 20)], "site_id int, r0 int, r1 int, c0 int, c1 int")
    f = A.faces(walls, ext, ["site_id"], 8)
    assert sorted(r["count"] for r in f.groupBy("face").count().collect()) == [200, 200]
    sides = A.wall_sides(walls, f, ["site_id"])
    assert A.unresolved_length(sides, ["site_id"], 1.0).first().unresolved_m == 5
    more = [*lines, (0, 7, 3, 10, 7, 10), (0, 8, 7, 8, 7, 12), (0, 9, 14, 0, 14, 3), (0, 10, 16, 3, 16, 6), (0, 11, 16, 6, 18, 6), (0, 12, 18, 6, 18, 3), (0, 13, 18, 3, 16, 3), (0, 14, 14, 3, 16, 3)]
    d = spark.createDataFrame([(s, i, *map(float, p)) for s, i, *p in more], "site_id int, line_id long, x1 double, y1 double, x2 double, y2 double")
    walls = A.wall_edges(d, ["site_id"], 1.0)
    r = A.unresolved_length(A.wall_sides(walls, A.faces(walls, ext, ["site_id"], 8), ["site_id"]), ["site_id"], 1.0).first()
    assert (r.cuts_m, r.dangles_m, r.unresolved_m) == (5.0, 13.0, 18.0)  # a bridge to an inner ring; a branched line and the loose one
    assert sorted(r.boundary_m for r in A.face_support(sides, ["site_id"], 1.0).collect()) == [60, 60]


def test_percentiles_and_numbers(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=5000)
    d = spark.createDataFrame([(0, float(v)) for v in a] + [(1, 3.0)] * 50, "k int, v double")
    got = {r.k: r.q for r in exact_percentiles(d, ["k"], "v", [0.0, 0.3, 0.75, 1.0]).collect()}
    assert got[0] == pytest.approx(np.quantile(a, [0, 0.3, 0.75, 1]).tolist()) and got[1] == [3.0] * 4
    again = {r.k: r.q for r in exact_percentiles(d, ["k"], "v", [0.0, 0.3, 0.75, 1.0], pieces=8, limit=50).collect()}
    assert again == got
    n = number_in_order(d.where("k = 0"), ["k"], ["v"], "n", F.floor(F.col("v") * 2)).orderBy("v").select("n").collect()
    assert [r.n for r in n] == list(range(1, 5001))


def test_growth_ends_after_its_steps(spark):
    cells = spark.range(45).selectExpr("0 site_id", "0 row", "cast(id as int) col", "if(id = 0, 7L, null) seed", "0 level")
    out = {r.col: r.label for r in R3.grow(cells, ["site_id"], 16, steps=30).collect()}
    assert out == {c: 7 if c <= 30 else None for c in range(45)}
    assert {r.label for r in R3.grow(cells, ["site_id"], 16).collect()} == {7}


def test_many_regions_are_stitched_at_once(spark):
    """The same rings as one region after the other, holes and diagonal cells included, however small the batches."""
    rng = np.random.default_rng(8)
    cells = [(s, r, c, int(rng.integers(3))) for s in range(3) for r in range(14) for c in range(14) if rng.random() < .8]
    d = spark.createDataFrame(cells, "site_id int, row int, col int, label long")
    edges = {}
    for e in G.outline_runs(d, ["site_id"]).collect():
        edges.setdefault((e.site_id, e.label), []).append((e.x1, e.y1, e.x2, e.y2))
    want = {k: [[(x * .5, y * .5) for x, y in ring] for ring in G.stitch(*zip(*v))] for k, v in edges.items()}
    for size in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.site_id, r.label): [[(p.x, p.y) for p in ring] for ring in r.rings] for r in G.polygonize(d, ["site_id"], .5).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert got == want
    assert G.polygonize(d.limit(0), ["site_id"], .5).count() == 0
    assert "FlatMapGroups" not in G.polygonize(d, ["site_id"], .5)._jdf.queryExecution().executedPlan().toString()  # no call for each region
