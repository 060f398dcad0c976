"""Road and parcel queries with SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.operators import pairs as P
from gridfold.operators import parcels as A
from gridfold.operators import roads as D
from gridfold.operators import spans as S
from gridfold.plans import bindings as B
from gridfold.plans.registry import query
from gridfold.plans.scoring import WIN
from gridfold.session import cut, pin

K = ["site_id"]


def thin(spark, folder, t=34):
    return B.mask(spark, folder, t)


THIN = B.RASTER + """, m AS (SELECT site_id, r, c FROM raster WHERE total >= 34 * n),
 e AS (SELECT a.site_id, a.r, a.c, b.r r2, b.c c2, a.r*2147483648+a.c u, b.r*2147483648+b.c v, sqrt(abs(a.r-b.r)+abs(a.c-b.c)) l FROM m a JOIN m b ON a.site_id=b.site_id AND ((b.r=a.r AND b.c=a.c+1) OR (b.r=a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1))),
 dg AS (SELECT m.site_id, r*2147483648+c node, count(q.node) degree FROM m LEFT JOIN (SELECT site_id, u node FROM e UNION ALL SELECT site_id, v FROM e) q ON q.site_id=m.site_id AND q.node=m.r*2147483648+m.c GROUP BY ALL)"""


ROADS = B.RASTER + ", rm AS (SELECT site_id, r, c FROM raster WHERE total >= 20 * n)" + B.thinned("rm")


@query("R15_skeleton", B.with_ctes(ROADS, 'SELECT site_id, r "row", c col FROM thin', True))
def skeleton(spark, folder):
    """Thinned road surface per site."""
    return D.skeleton(B.mask(spark, folder, 20), K, 32)


@query("R16_skeleton_graph", B.with_ctes(THIN + """, u2 AS (SELECT site_id, u, v FROM e UNION ALL SELECT site_id, v, u FROM e), rc AS (SELECT site_id, r*2147483648+c u, r*2147483648+c v FROM m UNION SELECT k.site_id, k.u, u2.v FROM rc k JOIN u2 ON u2.site_id=k.site_id AND u2.u=k.v)""",
  "SELECT dg.site_id, count(*) pixels, count(*) FILTER (degree=1) endpoints, count(*) FILTER (degree>2) junctions, any_value(n) components FROM dg JOIN (SELECT site_id, count(DISTINCT g) n FROM (SELECT site_id, u, min(v) g FROM rc GROUP BY ALL) GROUP BY ALL) q USING (site_id) GROUP BY dg.site_id", True))
def skeleton_graph(spark, folder):
    return D.graph_diagnostics(thin(spark, folder), K, 16)


@query("R17_centrelines", B.with_ctes(ROADS + B.touching("thin") + B.walks("ed", "site_id"), """SELECT site_id, first, second, pos, node // 2147483648 "row", node % 2147483648 col, round(along, 6) along FROM walked""", True))
def centrelines(spark, folder):
    """Ordered pixels of the centrelines of the thinned roads (R15)."""
    out = D.centreline_vertices(D.centrelines(D.skeleton(B.mask(spark, folder, 20), K, 32), K), K)
    return out.withColumn("along", F.round("along", 6))


def _covered(a: str, b: str, out: str) -> str:
    return f"""{out} AS (SELECT a.site_id, a.u, a.v, a.l, bool_or((a.x-(b.c+t*(b.c2-b.c)))**2 + (a.y-(b.r+t*(b.r2-b.r)))**2 <= 1.0 + 1e-9) ok FROM {a} a JOIN {b} b ON a.site_id=b.site_id AND b.c BETWEEN a.c - 3 AND a.c + 3 AND b.r BETWEEN a.r - 3 AND a.r + 3,
   LATERAL (SELECT greatest(0, least(1, ((a.x-b.c)*(b.c2-b.c)+(a.y-b.r)*(b.r2-b.r))/((b.c2-b.c)**2+(b.r2-b.r)**2))) t) GROUP BY ALL)"""


def _parts(edges: str, cells: str, out: str) -> str:
    return f"""{out}2 AS (SELECT site_id, u, v FROM {edges} UNION ALL SELECT site_id, v, u FROM {edges}), {out}r AS (SELECT site_id, r*2147483648+c u, r*2147483648+c v FROM {cells} UNION SELECT k.site_id, k.u, e.v FROM {out}r k JOIN {out}2 e ON e.site_id=k.site_id AND e.u=k.v),
 {out} AS (SELECT site_id, count(DISTINCT g) parts FROM (SELECT site_id, u, min(v) g FROM {out}r GROUP BY ALL) GROUP BY ALL)"""


SCORED = ROADS + ", pm AS (SELECT site_id, r, c FROM raster WHERE total >= 24 * n)" + B.thinned("pm", "p") + B.touching("thin") + B.touching("thinp", "p") + """,
 q AS (SELECT *, (r+r2)/2.0 y, (c+c2)/2.0 x FROM ed), p AS (SELECT *, (r+r2)/2.0 y, (c+c2)/2.0 x FROM edp), """ + ", ".join([_covered("p", "q", "pc"), _covered("q", "p", "qc"), _parts("ed", "thin", "nr"), _parts("edp", "thinp", "np")])


@query("R18_centreline_scores", B.with_ctes(SCORED, """SELECT nr.site_id, nr.parts reference_components, np.parts prediction_components, round(pk/pl, 6) "precision", round(rk/rl, 6) recall FROM nr JOIN np USING (site_id)
   JOIN (SELECT site_id, sum(l) pl FROM p GROUP BY ALL) a USING (site_id) JOIN (SELECT site_id, coalesce(sum(l) FILTER (ok), 0) pk FROM pc GROUP BY ALL) b USING (site_id)
   JOIN (SELECT site_id, sum(l) rl FROM q GROUP BY ALL) c USING (site_id) JOIN (SELECT site_id, coalesce(sum(l) FILTER (ok), 0) rk FROM qc GROUP BY ALL) d USING (site_id)""", True))
def centreline_scores(spark, folder):
    """Thinned roads (R15) of a stricter mask against those of the reference mask."""
    out = D.centreline_scores(B.mask(spark, folder, 20), B.mask(spark, folder, 24), K, 1.0, 2.0, 32)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def lines(spark, folder):
    """Survey lines of each site on a 32 x 32 m grid: a lattice every 8 m and loose segments."""
    bx = B.boxes(spark, folder)
    lat = bx.select("site_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    h = lat.selectExpr("site_id", "-1L - i line_id", "0D x1", "i * 8D y1", "32D x2", "i * 8D y2")
    v = lat.selectExpr("site_id", "-11L - i line_id", "i * 8D x1", "0D y1", "i * 8D x2", "32D y2")
    loose = bx.where("ok % 40 = 0").selectExpr("site_id", "feature_id line_id", "cast(x0 % 24 as double) x1", "cast(y0 % 32 as double) y1", "cast(x0 % 24 + w % 6 + 1 as double) x2", "cast(y0 % 32 as double) y2")
    return h.unionByName(v).unionByName(loose)


def extents(spark, folder):
    return B.boxes(spark, folder).select("site_id").distinct().selectExpr("site_id", "0 r0", "32 r1", "0 c0", "32 c1")


def walls_sql(more: str = "") -> str:
    return B.FP + """, ln AS (SELECT DISTINCT site_id, -1-i line_id, x, 8*i y, true across FROM fp, range(5) a(i), range(32) b(x) UNION ALL SELECT DISTINCT site_id, -11-i, 8*i, y, false FROM fp, range(5) a(i), range(32) b(y)
   UNION ALL SELECT site_id, feature_id, x0%24 + k, y0%32, true FROM fp, range(6) t(k) WHERE ok % 40 = 0 AND k <= w % 6""" + more + """),
 ws AS (SELECT DISTINCT site_id, x, y, across FROM ln), g AS (SELECT site_id, r, c FROM (SELECT DISTINCT site_id FROM fp), range(32) a(r), range(32) b(c)),
 st AS (SELECT a.site_id, a.r*32+a.c u, a.r*32+a.c+1 v FROM g a LEFT JOIN ws w ON w.site_id=a.site_id AND NOT across AND w.x=a.c+1 AND w.y=a.r WHERE a.c < 31 AND w.x IS NULL
   UNION ALL SELECT a.site_id, a.r*32+a.c, a.r*32+a.c+32 FROM g a LEFT JOIN ws w ON w.site_id=a.site_id AND across AND w.x=a.c AND w.y=a.r+1 WHERE a.r < 31 AND w.x IS NULL),
 s2 AS (SELECT * FROM st UNION ALL SELECT site_id, v, u FROM st), rc AS (SELECT site_id, r*32+c u, r*32+c v FROM g UNION SELECT k.site_id, k.u, s2.v FROM rc k JOIN s2 ON s2.site_id=k.site_id AND s2.u=k.v),
 fc AS (SELECT site_id, u//32 r, u%32 c, min(v) face FROM rc GROUP BY site_id, u)"""


WALLS = walls_sql()


def faces(spark, folder):
    walls = cut(A.wall_edges(lines(spark, folder), K, 1.0))
    f = A.faces(walls, extents(spark, folder), K, 16)
    return walls, cut(f.withColumn("face", F.expr("(face div 2147483648) * 32 + face % 2147483648")))


@query("R19_faces", B.with_ctes(WALLS, "SELECT site_id, face, count(*) area_m2 FROM fc GROUP BY ALL", True))
def face_list(spark, folder):
    return faces(spark, folder)[1].groupBy("site_id", "face").agg(F.count("*").alias("area_m2"))


SIDES = WALLS + """, sd AS (SELECT l.*, a.face fa, b.face fb FROM ln l LEFT JOIN fc a ON a.site_id=l.site_id AND a.r = CASE WHEN across THEN y-1 ELSE y END AND a.c = CASE WHEN across THEN x ELSE x-1 END
  LEFT JOIN fc b ON b.site_id=l.site_id AND b.r=y AND b.c=x)"""


# open ends are pruned step by step; what is loose and stays is a cut
PRUNED = SIDES + """, un AS (SELECT site_id, x, y, across, bool_and(fa IS NOT DISTINCT FROM fb) loose, y*100+x p, CASE WHEN across THEN y*100+x+1 ELSE (y+1)*100+x END q FROM sd GROUP BY ALL),
 pn AS (SELECT *, 0 it FROM un UNION ALL
   (WITH dg AS (SELECT site_id, node, count(*) d FROM (SELECT site_id, unnest([p, q]) node FROM pn) GROUP BY ALL),
    lf AS (SELECT n.*, a.d = 1 OR b.d = 1 leaf FROM pn n JOIN dg a ON a.site_id=n.site_id AND a.node=n.p JOIN dg b ON b.site_id=n.site_id AND b.node=n.q)
    SELECT site_id, x, y, across, loose, p, q, it + 1 FROM (SELECT *, bool_or(leaf) OVER (PARTITION BY site_id) any_ FROM lf) WHERE any_ AND NOT leaf)),
 ls AS (SELECT * FROM (SELECT *, max(it) OVER (PARTITION BY site_id) last FROM pn) WHERE it = last)"""


@query("R20_unresolved_lines", B.with_ctes(PRUNED, """SELECT u.site_id, round(count(l.it)*1.0, 3) cuts_m, round((count(*) - count(l.it))*1.0, 3) dangles_m, round(count(*)*1.0, 3) unresolved_m
   FROM un u LEFT JOIN ls l USING (site_id, x, y, across) WHERE u.loose GROUP BY ALL""", True))
def unresolved(spark, folder):
    walls, f = faces(spark, folder)
    return A.unresolved_length(A.wall_sides(walls, f, K), K, 1.0)


YARD = """ UNION ALL SELECT DISTINCT site_id, -21, 2, y, false FROM fp, range(2, 3) b(y) UNION ALL SELECT DISTINCT site_id, -22, 3, 2, false FROM fp UNION ALL SELECT DISTINCT site_id, -23, 2, 2, true FROM fp UNION ALL SELECT DISTINCT site_id, -24, 2, 3, true FROM fp"""
CHAIN = walls_sql(YARD) + """, ex AS (SELECT site_id, 7 id, r, c FROM g WHERE r < 8 AND c BETWEEN 16 AND 23 UNION ALL SELECT site_id, 8, r, c FROM g WHERE r BETWEEN 4 AND 11 AND c BETWEEN 8 AND 11),
 es AS (SELECT site_id, id, count(*) size FROM ex GROUP BY ALL), ow AS (SELECT site_id, face, count(*) cells, count(*) FILTER (site_id % 2 = 1 OR r < 28) inside, count(*) FILTER (site_id % 3 = 0 AND r BETWEEN 18 AND 20 AND c = 19) banned FROM fc GROUP BY ALL),
 mt AS (SELECT site_id, face, min(CASE WHEN cells + size - 2 * shared <= 0.01 THEN id END) same, min(id) FILTER (shared > 0.01) over_ FROM (SELECT site_id, face, id, count(*) shared FROM fc JOIN ex USING (site_id, r, c) GROUP BY ALL) JOIN es USING (site_id, id) JOIN ow USING (site_id, face) GROUP BY ALL),
 dc AS (SELECT *, CASE WHEN cells <= 1.0 THEN 'tiny' WHEN site_id % 2 = 0 AND inside < cells THEN 'outside_survey_extent' WHEN banned > 0.01 THEN 'excluded_area_intersection' WHEN same IS NOT NULL THEN 'equal_to_existing'
   WHEN over_ IS NOT NULL THEN 'existing_parcel_overlap' ELSE 'proposed' END decision FROM ow LEFT JOIN mt USING (site_id, face))"""


@query("R19_parcel_proposals", B.with_ctes(CHAIN, "SELECT site_id, face, cells, decision, CASE decision WHEN 'equal_to_existing' THEN same WHEN 'existing_parcel_overlap' THEN over_ ELSE -1 END existing_id FROM dc", True))
def proposals(spark, folder):
    """Faces with a yard of one cell more, against a survey extent (even sites), an excluded strip (every third site) and two parcels that stand already."""
    sites = B.boxes(spark, folder).select("site_id").distinct()
    yard = sites.selectExpr("site_id", "explode(array(named_struct('l', -21L, 'a', 2D, 'b', 2D, 'c', 2D, 'd', 3D), named_struct('l', -22L, 'a', 3D, 'b', 2D, 'c', 3D, 'd', 3D), named_struct('l', -23L, 'a', 2D, 'b', 2D, 'c', 3D, 'd', 2D), named_struct('l', -24L, 'a', 2D, 'b', 3D, 'c', 3D, 'd', 3D))) s")
    walls = A.wall_edges(lines(spark, folder).unionByName(yard.selectExpr("site_id", "s.l line_id", "s.a x1", "s.b y1", "s.c x2", "s.d y2")), K, 1.0)
    f = cut(A.faces(cut(walls), extents(spark, folder), K, 16).withColumn("face", F.expr("(face div 2147483648) * 32 + face % 2147483648")))
    cells = lambda df, rows, cols, *more: df.selectExpr("site_id", f"explode(sequence({rows})) row", *more).selectExpr("*", f"explode(sequence({cols})) col")
    survey = cells(sites.where("site_id % 2 = 0"), "0, 27", "0, 31")
    banned = cells(sites.where("site_id % 3 = 0"), "18, 20", "19, 19")
    standing = cells(sites, "0, 7", "16, 23", "7L parcel_id").unionByName(cells(sites, "4, 11", "8, 11", "8L parcel_id"))
    return A.propose_parcels(f, survey, banned, standing, K, 1.0, tiny=1.0).na.fill(-1, ["existing_id"])


SUPPORT = SIDES + ", su AS (SELECT site_id, face, count(DISTINCT line_id) lines, count(DISTINCT (x, y, across)) len FROM (SELECT *, unnest([fa, fb]) face FROM sd WHERE fa IS DISTINCT FROM fb) WHERE face IS NOT NULL GROUP BY ALL)"


@query("J22_face_support", B.with_ctes(SUPPORT, "SELECT site_id, face, lines FROM su", True))
def face_support(spark, folder):
    walls, f = faces(spark, folder)
    return A.face_support(A.wall_sides(walls, f, K), K, 1.0).select("site_id", "face", "lines")


@query("A31_boundary_evidence", B.with_ctes(SUPPORT + """, pm AS (SELECT f.site_id, f.face, count(*) FILTER (n.face IS NULL OR n.face <> f.face) per FROM fc f CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0)) d(dr,dc) LEFT JOIN fc n ON n.site_id=f.site_id AND n.r=f.r+dr AND n.c=f.c+dc GROUP BY ALL)""",
  "SELECT site_id, face, round(least(1, len / per), 6) coverage FROM su JOIN pm USING (site_id, face)", True))
def boundary_evidence(spark, folder):
    """Share of each face's boundary that lies on reviewed lines, at most 1."""
    from gridfold.operators.regions import outline_runs
    walls, f = faces(spark, folder)
    per = outline_runs(f.withColumnRenamed("face", "label"), K).groupBy("site_id", F.col("label").alias("face")).agg(F.count("*").alias("perimeter"))
    sup = A.face_support(A.wall_sides(walls, f, K), K, 1.0)
    return sup.join(per, ["site_id", "face"]).select("site_id", "face", F.round(F.least(F.lit(1.0), F.col("boundary_m") / F.col("perimeter")), 6).alias("coverage"))


REFS = WALLS + ", rf AS (SELECT site_id, (r//8)*4 + c//8 ref_id, r, c FROM g WHERE ((r//8)*4 + c//8) % 3 <> 0 AND NOT (((r//8)*4 + c//8) % 4 = 1 AND r % 8 < 3))"
CMP = REFS + ", cp AS (SELECT site_id, face, ref_id, count(*) sh FROM fc JOIN rf USING (site_id, r, c) GROUP BY ALL), fa AS (SELECT site_id, face, count(*) n FROM fc GROUP BY ALL), ra AS (SELECT site_id, ref_id, count(*) n FROM rf GROUP BY ALL)"


def references(spark, folder):
    g = extents(spark, folder).selectExpr("site_id", "explode(sequence(0, 31)) row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(31))))
    g = g.withColumn("ref_id", F.expr("cast((row div 8) * 4 + col div 8 as bigint)"))
    return g.where("ref_id % 3 <> 0 and not (ref_id % 4 = 1 and row % 8 < 3)")


@query("J10_reference_overlap", B.with_ctes(CMP, "SELECT cp.site_id, face, ref_id, round(sh/(fa.n+ra.n-sh), 6) iou, round(sh/ra.n, 6) reference_fraction, NOT bool_or(sh/(fa.n+ra.n-sh) >= 0.9) OVER (PARTITION BY cp.site_id, face) AS conflict FROM cp JOIN fa USING (site_id, face) JOIN ra USING (site_id, ref_id)", True))
def reference_overlap(spark, folder):
    d = A.compare_faces(faces(spark, folder)[1], references(spark, folder), K)
    ok = d.groupBy("site_id", "face").agg((~F.bool_or(F.col("iou") >= 0.9)).alias("conflict"))
    return d.join(ok, ["site_id", "face"]).select("site_id", "face", "ref_id", F.round("iou", 6).alias("iou"), F.round("reference_fraction", 6).alias("reference_fraction"), "conflict")


@query("R31_equal_faces", B.with_ctes(CMP, "SELECT cp.site_id, face, ref_id FROM cp JOIN fa USING (site_id, face) JOIN ra USING (site_id, ref_id) WHERE fa.n + ra.n - 2*sh <= 0.01", True))
def equal_faces(spark, folder):
    d = A.compare_faces(faces(spark, folder)[1], references(spark, folder), K)
    return d.where("face_cells + ref_cells - 2 * shared <= 0.01").select("site_id", "face", "ref_id")


def zone(spark, folder, r0, r1, c0, c1):
    return B.boxes(spark, folder).select("site_id").distinct().selectExpr("site_id", f"explode(sequence({r0}, {r1 - 1})) row", f"{c0} c0", f"{c1} c1")


def parcel_spans(spark, folder):
    return B.covered(B.footprints(spark, folder), "feature_id").select("site_id", "id", "spans", "cells")


PAR = WIN + ", pcell AS (SELECT * FROM cells)"


@query("A28_uncovered_extent", B.with_ctes(PAR, """, ex AS (SELECT site_id, r, c FROM (SELECT DISTINCT site_id FROM fp), range(650) a(r), range(650) b(c))
 SELECT site_id, count(*) uncovered_cells FROM ex ANTI JOIN (SELECT site_id, r, c FROM pcell) p USING (site_id, r, c) WHERE NOT (r BETWEEN 300 AND 349 AND c BETWEEN 300 AND 349) GROUP BY ALL"""))
def uncovered(spark, folder):
    return A.uncovered_cells(zone(spark, folder, 0, 650, 0, 650), S.explode_spans(parcel_spans(spark, folder), "site_id"), zone(spark, folder, 300, 350, 300, 350), K)


@query("A29_parcel_conflicts", B.with_ctes(PAR, """, o AS (SELECT a.site_id, a.feature_id a, b.feature_id b FROM pcell a JOIN pcell b USING (site_id, r, c) WHERE a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) > 1)
 SELECT site_id, 'overlap' conflict, count(*) n FROM o GROUP BY ALL
 UNION ALL SELECT site_id, 'outside_survey_extent', count(DISTINCT feature_id) FROM pcell WHERE r >= 650 OR c >= 650 GROUP BY ALL
 UNION ALL SELECT site_id, 'excluded_area_intersection', count(*) FROM (SELECT site_id, feature_id FROM pcell WHERE r BETWEEN 300 AND 349 AND c BETWEEN 300 AND 349 GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL"""))
def parcel_conflicts(spark, folder):
    p = cut(parcel_spans(spark, folder))
    two = P.overlap_pairs(p, p, K).where("a < b and inter > 1").groupBy("site_id").agg(F.count("*").alias("n")).select("site_id", F.lit("overlap").alias("conflict"), "n")
    one = A.parcel_conflicts(p, zone(spark, folder, 0, 650, 0, 650), zone(spark, folder, 300, 350, 300, 350), K, 1)
    return two.unionByName(one.groupBy("site_id", "conflict").agg(F.count("*").alias("n")))


def observations(spark, folder):
    """Observed sides of each parcel: the first (id mod 5) sides of its rectangle."""
    bx = B.boxes(spark, folder)
    sha = F.sha2(F.concat_ws(",", "x0", "y0", "w", "h"), 256)
    parcels = B._rings(bx).select("site_id", F.col("feature_id").alias("parcel_id"), sha.alias("geometry_sha256"), "rings")
    obs = B._rings(bx).select("site_id", F.col("feature_id").alias("parcel_id"), F.when(F.col("ok") % 13 == 0, F.lit("old")).otherwise(sha).alias("geometry_sha256"),
                              (F.col("ok") % 7 != 0).alias("reviewed"), F.expr("case ok % 3 when 0 then 'gnss' when 1 then 'ets' else 'photo' end").alias("method"),
                              (F.col("ok") % 8 / 10.0).alias("accuracy_m"), F.explode(F.slice(M.segments(F.col("rings")), 1, (F.col("ok") % 5).cast("int"))).alias("s"))
    return obs, parcels


ELIG = B.FP + ", el AS (SELECT * FROM fp WHERE ok % 13 <> 0 AND ok % 7 <> 0 AND ok % 3 <> 2 AND ok % 8 <= 5 AND ok % 5 > 0)"


@query("J21_eligible_observations", B.with_ctes(ELIG, "SELECT site_id, feature_id parcel_id, CAST(ok % 5 AS BIGINT) observations FROM el"))
def eligible(spark, folder):
    obs, parcels = observations(spark, folder)
    return A.eligible_observations(obs, parcels, K).groupBy("site_id", "parcel_id").agg(F.count("*").alias("observations"))


@query("A30_field_coverage", B.with_ctes(ELIG, """SELECT site_id, feature_id parcel_id, round(s/(2*(w+h)), 6) coverage, s/(2*(w+h)) >= 0.95 AS enough FROM (SELECT *, CASE ok % 5 WHEN 1 THEN w WHEN 2 THEN w+h WHEN 3 THEN 2*w+h ELSE 2*(w+h) END s FROM el)"""))
def field_coverage(spark, folder):
    """Share of the parcel boundary within tolerance of eligible observations (4 cm here)."""
    obs, parcels = observations(spark, folder)
    ids = ["site_id", "parcel_id"]
    seen = A.eligible_observations(obs, parcels, K).select(*ids, "s.*").distinct()
    edge = parcels.join(seen.select(*ids).distinct(), ids).select(*ids, F.explode(M.segments(F.col("rings"))).alias("s")).select(*ids, "s.*")
    d = D.line_coverage(edge, seen, ids, 0.04, B.RES).withColumn("c", F.col("covered") / F.col("total"))
    return d.select(*ids, F.round("c", 6).alias("coverage"), (F.col("c") >= 0.95).alias("enough"))


@query("S17_evidence_kinds", """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'unknown_kind' WHEN doc_id % 6 = 0 AND doc_id % 3 <> 1 AND doc_id % 4 <> 1 THEN 'geometry_type' WHEN doc_id % 6 = 1 AND doc_id % 4 = 2 THEN 'geometry_type'
  WHEN doc_id % 6 IN (2, 3, 4) AND doc_id % 4 <> 2 THEN 'geometry_type' END error FROM documents""")
def evidence_kinds(spark, folder):
    kind = F.expr("case doc_id % 6 when 0 then 'boundary_segment' when 1 then 'survey_observation' when 2 then 'reference_parcel' when 3 then 'excluded_area' when 4 then 'survey_extent' else 'roof' end")
    geom = F.expr("case doc_id % 4 when 0 then 'Point' when 1 then 'LineString' when 2 then 'Polygon' else 'Point' end")
    return B.table(spark, folder, "documents").select("doc_id", A.kind_errors(kind, geom).alias("error"))
