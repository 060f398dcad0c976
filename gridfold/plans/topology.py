"""Measures, predicates, spatial joins and topology queries with SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.functions import projection as G
from gridfold.operators import pairs as P
from gridfold.operators import scoring as C
from gridfold.operators import spans as S
from gridfold.operators import topology as O
from gridfold.plans import bindings as B
from gridfold.plans.registry import query
from gridfold.plans.scoring import WIN
from gridfold.session import cut, dealt, pin



def R():
    return F.col("rings")


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("P1_area", B.with_ctes(B.AREA, "SELECT site_id, feature_id, round(n * 0.01, 6) area_m2 FROM ar"))
def area(spark, folder):
    return B.footprints(spark, folder).select("site_id", "feature_id", r6(M.area(R()), "area_m2"))


@query("P2_compactness", B.with_ctes(B.AREA, """SELECT site_id, feature_id, round(2*(w+h)*0.1, 6) perimeter_m,
  round(4*pi()*n*0.01 / ((2*(w+h)*0.1)*(2*(w+h)*0.1)), 6) compactness FROM ar"""))
def compactness(spark, folder):
    return B.footprints(spark, folder).select("site_id", "feature_id", r6(M.perimeter(R()), "perimeter_m"), r6(M.compactness(R()), "compactness"))


@query("P3_bounds", B.with_ctes(B.FP, """SELECT site_id, feature_id, round(x0*0.1,6) xmin, round(y0*0.1,6) ymin,
  round((x0+w)*0.1,6) xmax, round((y0+h)*0.1,6) ymax FROM fp"""))
def bounds(spark, folder):
    b = pin(B.footprints(spark, folder), b=M.bounds(R()))
    return b.select("site_id", "feature_id", *[r6(F.col(f"b.{c}"), c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("P4_centroid", B.with_ctes(B.AREA, """SELECT site_id, feature_id,
  round((x0 + CASE WHEN lshape THEN (w*h*w/2.0 - (w-w//2)*(h-h//2)*(w//2+(w-w//2)/2.0))/n ELSE w/2.0 END)*0.1, 5) cx,
  round((y0 + CASE WHEN lshape THEN (w*h*h/2.0 - (w-w//2)*(h-h//2)*(h//2+(h-h//2)/2.0))/n ELSE h/2.0 END)*0.1, 5) cy,
  round((2*x0 + CASE WHEN lshape AND (2*y0+h-1)//2 - y0 >= h//2 THEN w//2 ELSE w END)*0.1/2, 6) px,
  round(((2*y0+h-1)//2 + 0.5)*0.1, 6) py FROM ar"""))
def centroid(spark, folder):
    d = B.covered(B.footprints(spark, folder), "feature_id")
    d = pin(d, c=M.centroid(R()), p=S.interior_point(F.col("spans"), B.RES))
    return d.select("site_id", F.col("id").alias("feature_id"), F.round("c.x", 5).alias("cx"), F.round("c.y", 5).alias("cy"), r6(F.col("p.x"), "px"), r6(F.col("p.y"), "py"))


@query("P5_bbox_query", B.with_ctes(B.FP, """SELECT site_id, feature_id FROM fp WHERE x0 <= 300 AND x0+w >= 100 AND y0 <= 400 AND y0+h >= 200"""))
def bbox_query(spark, folder):
    """Bounding boxes stored as flat columns, so the interval test reaches the Parquet scan."""
    from gridfold.sources.features import bbox_query as find, write_features
    path = write_features(B.footprints(spark, folder))
    return find(spark.read.parquet(path), 10.0, 20.0, 30.0, 40.0).select("site_id", "feature_id").orderBy("feature_id")


@query("P7_min_area", B.with_ctes(B.AREA, "SELECT site_id, count(*) features FROM ar WHERE n >= 50 GROUP BY ALL"))
def min_area(spark, folder):
    return pin(B.footprints(spark, folder), a=M.area(R())).where("a >= 0.5 - 1e-9").groupBy("site_id").agg(F.count("*").alias("features"))


# pairs of representative shapes within 3 cells, per site (row spans keep the SQL light)
NEAR = B.AREA + """,
sh AS (SELECT site_id, x0, y0, w, h, lshape, n, min(feature_id) id, count(*) members FROM ar GROUP BY ALL),
rs AS (SELECT site_id, id, y0+dy r, x0 c0, x0 + CASE WHEN lshape AND dy >= h//2 THEN w//2 ELSE w END c1 FROM sh, range(h) t(dy)),
gp AS (SELECT a.site_id, a.id a, b.id b, min(greatest(0, b.c0-a.c1, a.c0-b.c1)**2 + greatest(0, abs(o)-1)**2) g
  FROM (SELECT *, unnest(range(-4,5)) o FROM rs) a JOIN rs b ON a.site_id=b.site_id AND b.r = a.r + o AND a.id < b.id
   AND b.c0 <= a.c1 + 3 AND a.c0 <= b.c1 + 3 GROUP BY ALL),
nb AS (SELECT g.site_id, a, b, CAST(x.members*y.members AS BIGINT) pairs, CAST(g AS BIGINT) gap_cells_sq FROM gp g JOIN sh x ON x.id=a AND x.site_id=g.site_id
   JOIN sh y ON y.id=b AND y.site_id=g.site_id WHERE g <= 9
  UNION ALL SELECT site_id, id, id, members*(members-1)//2, 0 FROM sh WHERE members > 1)"""


@query("J1_pairs_within", B.with_ctes(NEAR, "SELECT * FROM nb"))
def pairs_within(spark, folder):
    return P.pairs_within(B.footprints(spark, folder), ["site_id"], 0.3, B.RES)


@query("P8_display_flags", B.with_ctes(NEAR, """, touched AS (SELECT site_id, a id FROM nb UNION SELECT site_id, b FROM nb)
  SELECT a.site_id, a.feature_id, concat_ws(',', CASE WHEN a.n < 30 THEN 'small_roof' END, CASE WHEN a.n > 90 THEN 'possible_merged_buildings' END,
   CASE WHEN t.id IS NOT NULL THEN 'touching_neighbour' END, CASE WHEN a.feature_id % 100 < 70 THEN 'low_score' END) flags
  FROM ar a JOIN sh s ON s.site_id=a.site_id AND s.x0=a.x0 AND s.y0=a.y0 AND s.w=a.w AND s.h=a.h AND s.lshape=a.lshape
  LEFT JOIN touched t ON t.site_id=s.site_id AND t.id=s.id"""))
def flags(spark, folder):
    return _flagged(spark, folder).select("site_id", "feature_id", F.array_join("flags", ",").alias("flags"))


def _flagged(spark, folder):
    f = O.with_neighbour_flag(B.footprints(spark, folder), B.RES)
    f = pin(f, a=F.round(M.area(R()), 6))
    return f.withColumn("flags", O.display_flags(F.col("a"), F.col("has_neighbour"), (F.col("feature_id") % 100) / 100.0, True, 0.3, 0.9, 0.7))


@query("A21_flag_counts", B.with_ctes(NEAR, """, touched AS (SELECT site_id, a id FROM nb UNION SELECT site_id, b FROM nb),
  fl AS (SELECT a.site_id, unnest(['small_roof','possible_merged_buildings','touching_neighbour','low_score']) flag,
   unnest([a.n < 30, a.n > 90, t.id IS NOT NULL, a.feature_id % 100 < 70]) on_
  FROM ar a JOIN sh s ON s.site_id=a.site_id AND s.x0=a.x0 AND s.y0=a.y0 AND s.w=a.w AND s.h=a.h AND s.lshape=a.lshape
  LEFT JOIN touched t ON t.site_id=s.site_id AND t.id=s.id) SELECT site_id, flag, count(*) features FROM fl WHERE on_ GROUP BY ALL"""))
def flag_counts(spark, folder):
    joined = _flagged(spark, folder).select("site_id", F.array_join("flags", ",").alias("flags"))
    return joined.select("site_id", F.explode(F.filter(F.split("flags", ","), lambda f: f != "")).alias("flag")).groupBy("site_id", "flag").agg(F.count("*").alias("features"))


REL = B.SHAPES + """,
rs AS (SELECT site_id, feature_type, id, n, members, y0+dy r, x0 c0, x0 + CASE WHEN lshape AND dy >= h//2 THEN w//2 ELSE w END c1 FROM sh, range(h) t(dy)),
gp AS (SELECT a.site_id, a.feature_type, a.id a, b.id b, any_value(a.n) an, any_value(b.n) bn, any_value(a.members*b.members) pairs,
   min(greatest(0, b.c0-a.c1, a.c0-b.c1)**2 + greatest(0, abs(o)-1)**2) g,
   CAST(sum(CASE WHEN o = 0 THEN greatest(0, least(a.c1,b.c1)-greatest(a.c0,b.c0)) ELSE 0 END) AS BIGINT) inter
  FROM (SELECT *, unnest(range(-4,5)) o FROM rs) a JOIN rs b ON a.site_id=b.site_id AND a.feature_type=b.feature_type AND b.r = a.r + o AND a.id < b.id
   AND b.c0 <= a.c1 + 3 AND a.c0 <= b.c1 + 3 GROUP BY ALL),
cls AS MATERIALIZED (SELECT *, inter / (an+bn-inter) iou, inter / least(an,bn) frac,
   CASE WHEN inter/(an+bn-inter) >= 0.9 THEN 'duplicate' WHEN inter >= 25 AND inter/least(an,bn) >= 0.05 THEN 'overlap' END rel FROM gp WHERE g <= 9),
ed AS MATERIALIZED (SELECT site_id, feature_type, id, 2*c0 mx, 2*r+1 my, false hz FROM rs UNION ALL SELECT site_id, feature_type, id, 2*c1, 2*r+1, false FROM rs
  UNION ALL SELECT site_id, feature_type, id, 2*(x0+dx)+1, 2*y0, true FROM sh, range(w) t(dx)
  UNION ALL SELECT site_id, feature_type, id, 2*(x0+dx)+1, 2*(y0 + CASE WHEN lshape AND dx >= w//2 THEN h//2 ELSE h END), true FROM sh, range(w) t(dx)
  UNION ALL SELECT site_id, feature_type, id, 2*(x0+w//2), 2*(y0+dy)+1, false FROM sh, range(h) t(dy) WHERE false),
shb AS MATERIALIZED (SELECT site_id, feature_type, a, b, count(DISTINCT (mx,my)) * 0.1 len FROM (
   SELECT c.site_id, c.feature_type, c.a, c.b, eb.mx, eb.my FROM cls c JOIN ed ea ON ea.id=c.a
    JOIN ed eb ON eb.id=c.b
   WHERE c.rel IS NULL AND greatest(0, abs(ea.mx-eb.mx) - CASE WHEN ea.hz THEN 1 ELSE 0 END)**2 + greatest(0, abs(ea.my-eb.my) - CASE WHEN ea.hz THEN 0 ELSE 1 END)**2 <= 36)
  GROUP BY ALL),
rel AS (SELECT c.site_id, c.feature_type, c.a, c.b, pairs, coalesce(rel, 'shared_boundary') relation, iou, inter*0.01 overlap_m2, frac fraction,
    CASE WHEN rel IS NULL THEN len ELSE 0 END length_m
  FROM cls c LEFT JOIN shb s ON s.site_id=c.site_id AND s.feature_type=c.feature_type AND s.a=c.a AND s.b=c.b WHERE rel IS NOT NULL OR len >= 0.5 - 1e-9
  UNION ALL SELECT site_id, feature_type, id, id, members*(members-1)//2, 'duplicate', 1, n*0.01, 1, 0 FROM sh WHERE members > 1),
rl AS (SELECT *, CASE WHEN relation='duplicate' THEN 'error' WHEN relation='overlap' THEN CASE WHEN fraction >= 0.3 THEN 'error' ELSE 'warning' END ELSE 'none' END severity FROM rel)"""


def relations(spark, folder):
    return O.pair_relations(B.footprints(spark, folder), B.RES)


@query("J13_pair_relations", B.with_ctes(REL, """SELECT site_id, feature_type, a, b, pairs, relation, round(iou,6) iou, round(overlap_m2,6) overlap_m2,
  round(fraction,6) fraction, round(length_m,6) length_m, severity FROM rl"""))
def pair_relations(spark, folder):
    d = relations(spark, folder)
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("J14_shared_boundaries", B.with_ctes(REL, """SELECT site_id, feature_type, count(*) shared, round(sum(length_m),6) length_m FROM rl
  WHERE relation = 'shared_boundary' GROUP BY ALL"""))
def shared(spark, folder):
    return (relations(spark, folder).where("relation = 'shared_boundary'").groupBy("site_id", "feature_type")
            .agg(F.count("*").alias("shared"), F.round(F.sum(F.round("length_m", 6).cast("decimal(20,6)")).cast("double"), 6).alias("length_m")))


@query("P17_overlap_severity", B.with_ctes(REL, "SELECT site_id, severity, count(*) shapes, CAST(sum(pairs) AS BIGINT) pairs FROM rl WHERE relation='overlap' GROUP BY ALL"))
def overlap_severity(spark, folder):
    return relations(spark, folder).where("relation = 'overlap'").groupBy("site_id", "severity").agg(F.count("*").alias("shapes"), F.sum("pairs").alias("pairs"))


GAPS = B.CELLS + """, un AS (SELECT DISTINCT site_id, feature_type, r, c FROM cells),
 disc AS (SELECT dy, dx FROM range(-2,3) a(dy), range(-2,3) b(dx) WHERE dx*dx+dy*dy <= 6.25),
 gr AS (SELECT DISTINCT site_id, feature_type, r+dy r, c+dx c FROM un, disc),
 fr AS (SELECT * FROM gr ANTI JOIN un USING (site_id, feature_type, r, c)),
 ou AS (SELECT DISTINCT site_id, feature_type, r+dy r, c+dx c FROM fr, disc EXCEPT SELECT * FROM gr),
 gap AS (SELECT * FROM fr EXCEPT SELECT site_id, feature_type, r+dy r, c+dx c FROM ou, disc),
 ge AS (SELECT a.site_id, a.feature_type, a.r*2147483648+a.c u, b.r*2147483648+b.c v FROM gap a JOIN gap b ON a.site_id=b.site_id AND a.feature_type=b.feature_type AND abs(a.r-b.r)+abs(a.c-b.c)=1 AND b.r BETWEEN a.r-1 AND a.r+1 AND (b.c=a.c OR b.r=a.r)),
 rc AS (SELECT site_id, feature_type, r*2147483648+c u, r*2147483648+c v FROM gap UNION SELECT k.site_id, k.feature_type, k.u, e.v FROM rc k JOIN ge e ON e.site_id=k.site_id AND e.feature_type=k.feature_type AND e.u=k.v),
 gc AS (SELECT site_id, feature_type, CAST(u//2147483648 AS BIGINT) r, CAST(u%2147483648 AS BIGINT) c, min(v) g FROM rc GROUP BY site_id, feature_type, u),
 bg AS (SELECT site_id, feature_type, g, count(*) n FROM gc GROUP BY ALL HAVING count(*) >= 10 AND sqrt((max(r)-min(r)+1)**2 + (max(c)-min(c)+1)**2) >= 10),
 pt AS (SELECT DISTINCT site_id, feature_type, g, r + dy y, c_ x FROM (SELECT site_id, feature_type, g, r, unnest([lo, hi]) c_ FROM (SELECT site_id, feature_type, g, r, min(c) lo, max(c) + 1 hi FROM gc JOIN bg USING (site_id, feature_type, g) GROUP BY ALL)), range(2) d(dy)),
 hs AS (SELECT p.site_id, p.feature_type, p.g, q.x - p.x dx, q.y - p.y dy FROM pt p JOIN pt q USING (site_id, feature_type, g) JOIN pt o USING (site_id, feature_type, g) WHERE p.x <> q.x OR p.y <> q.y
   GROUP BY p.site_id, p.feature_type, p.g, p.x, p.y, q.x, q.y HAVING min((q.x-p.x)*(o.y-p.y) - (q.y-p.y)*(o.x-p.x)) >= 0),
 hr AS (SELECT site_id, feature_type, g, (max(dx*x+dy*y) - min(dx*x+dy*y)) a, (max(dx*y-dy*x) - min(dx*y-dy*x)) b, any_value(dx*dx+dy*dy) q FROM (SELECT DISTINCT * FROM hs) JOIN pt USING (site_id, feature_type, g) GROUP BY site_id, feature_type, g, dx, dy),
 hl AS (SELECT site_id, feature_type, g, sqrt(greatest(a, b)**2 / q) len FROM hr QUALIFY row_number() OVER (PARTITION BY site_id, feature_type, g ORDER BY a * b / q, greatest(a, b)**2 / q DESC) = 1),
 big AS (SELECT site_id, feature_type, g, n, len * 0.1 length_m FROM bg JOIN hl USING (site_id, feature_type, g) WHERE len * 0.1 >= 1.0 - 1e-9),
 nr AS (SELECT DISTINCT q.site_id, q.feature_type, q.g, feature_id FROM (SELECT gc.*, dy, dx FROM gc JOIN big USING (site_id, feature_type, g), range(-1,2) a(dy), range(-1,2) b(dx)) q
   JOIN cells k ON k.site_id=q.site_id AND k.feature_type=q.feature_type AND k.r=q.r+dy AND k.c=q.c+dx)"""


TWISTED = 211  # of so many features one has a twisted ring, and takes no part in pairs and gaps


def _whole(ctes: str, live: str = "true") -> str:
    """The same CTEs over the features that are live and whole; ``fp0`` keeps all that are live."""
    all_of = B.FP.replace("fp AS (", "fpa AS (", 1) + f", fp0 AS (SELECT * FROM fpa WHERE {live}), fp AS (SELECT * FROM fp0 WHERE ok % {TWISTED} <> 1)"
    return ctes.replace(B.FP, all_of)


CONFLICTS = REL + GAPS[len(B.FP):] + f""", cf AS (SELECT site_id, feature_type, a, b, pairs, relation, severity FROM rl
  UNION ALL SELECT site_id, feature_type, min(feature_id), CAST(g AS BIGINT), 1, 'gap_sliver', 'warning' FROM nr GROUP BY site_id, feature_type, g HAVING count(*) >= 2
  UNION ALL SELECT site_id, feature_type, feature_id, feature_id, 1, 'invalid_geometry', 'error' FROM fp0 WHERE ok % {TWISTED} = 1)"""
SUMMARY = """CAST(coalesce(sum(CASE WHEN relation='invalid_geometry' THEN pairs ELSE 0 END), 0) AS BIGINT) invalid, CAST(coalesce(sum(CASE WHEN relation='gap_sliver' THEN pairs ELSE 0 END), 0) AS BIGINT) gaps,
  CAST(coalesce(sum(CASE WHEN relation='duplicate' THEN pairs ELSE 0 END), 0) AS BIGINT) duplicates,
  CAST(coalesce(sum(CASE WHEN relation='overlap' THEN pairs ELSE 0 END), 0) AS BIGINT) overlapping, CAST(coalesce(sum(CASE WHEN severity='error' THEN pairs ELSE 0 END), 0) AS BIGINT) errors,
  CAST(coalesce(sum(CASE WHEN severity='warning' THEN pairs ELSE 0 END), 0) AS BIGINT) warnings,
  CAST(coalesce(sum(CASE WHEN relation='shared_boundary' THEN pairs ELSE 0 END), 0) AS BIGINT) shared_boundaries,
  coalesce(sum(CASE WHEN severity <> 'none' THEN pairs ELSE 0 END), 0) = 0 AS valid"""
LAYERS = "(SELECT DISTINCT {k} FROM fp0) l LEFT JOIN cf USING ({k})"


def checked(spark, folder, live="true"):
    """Live footprints, some with a twisted ring, and their conflict table."""
    d = B._rings(B.boxes(spark, folder).where(live))
    ring = F.col("rings")[0]
    twisted = F.array(F.array(*[ring[i] for i in (0, 2, 1, 3)], ring[0]))
    d = d.withColumn("rings", F.when(F.col("ok") % TWISTED == 1, twisted).otherwise(F.col("rings"))).select("site_id", "feature_id", "feature_type", "rings")
    return d, O.conflict_table(d, B.RES)


@query("A15_conflict_summary", B.with_ctes(_whole(CONFLICTS), f"SELECT site_id, {SUMMARY} FROM {LAYERS.format(k='site_id')} GROUP BY ALL", True))
def conflict_summary(spark, folder):
    d, rows = checked(spark, folder)
    return O.relation_summary(rows, d, ["site_id"])


@query("A16_class_summaries", B.with_ctes(_whole(CONFLICTS), f"""SELECT q.*, bool_and(valid) OVER (PARTITION BY site_id) all_valid FROM (
  SELECT site_id, feature_type, {SUMMARY} FROM {LAYERS.format(k='site_id, feature_type')} GROUP BY ALL) q""", True))
def class_summaries(spark, folder):
    d, rows = checked(spark, folder)
    per = cut(O.relation_summary(rows, d, ["site_id", "feature_type"]))
    return per.join(per.groupBy("site_id").agg(F.bool_and("valid").alias("all_valid")), "site_id")


@query("L3_conflict_order", B.with_ctes(_whole(CONFLICTS), """SELECT site_id, a, b, relation, format('conflict-{:03d}', row_number() OVER (PARTITION BY site_id
  ORDER BY CASE relation WHEN 'invalid_geometry' THEN 0 WHEN 'duplicate' THEN 1 WHEN 'overlap' THEN 2 ELSE 3 END, a, b, feature_type)) conflict_id FROM cf WHERE severity <> 'none'""", True))
def conflict_order(spark, folder):
    return O.number_conflicts(checked(spark, folder)[1]).select("site_id", "a", "b", "relation", "conflict_id")


@query("J23_inspector_relations", B.with_ctes(REL, """SELECT site_id, CASE WHEN a % 500 = 7 THEN a ELSE b END feature_id, CASE WHEN a % 500 = 7 THEN b ELSE a END other, relation
  FROM rl WHERE a <> b AND ((a % 500 = 7) <> (b % 500 = 7) OR (a % 500 = 7 AND b % 500 = 7))"""))
def inspector(spark, folder):
    """Relations of inspected features (ids that leave 7 modulo 500); L5 orders them by type, id."""
    d = relations(spark, folder).where("a <> b")
    hit = F.col("a") % 500 == 7
    d = d.where(hit | (F.col("b") % 500 == 7))
    return d.select("site_id", F.when(hit, F.col("a")).otherwise(F.col("b")).alias("feature_id"),
                    F.when(hit, F.col("b")).otherwise(F.col("a")).alias("other"), "relation").orderBy("feature_id", "relation", "other")


@query("L5_relation_order", B.with_ctes(REL, """SELECT site_id, relation, arg_min(a, (a, b)) first_a, arg_min(b, (a, b)) first_b, count(*) listed FROM rl GROUP BY ALL"""))
def relation_order(spark, folder):
    return relations(spark, folder).groupBy("site_id", "relation").agg(
        F.min(F.struct("a", "b")).alias("m"), F.count("*").alias("listed")).select("site_id", "relation", F.col("m.a").alias("first_a"), F.col("m.b").alias("first_b"), "listed")


@query("J24_workspace_topology", B.with_ctes(_whole(CONFLICTS, "ok % 4 <> 3"), f"SELECT site_id, {SUMMARY} FROM {LAYERS.format(k='site_id')} GROUP BY ALL", True))
def workspace_topology(spark, folder):
    """Rejected workspace features (one of four) take no part."""
    d, rows = checked(spark, folder, "ok % 4 <> 3")
    return O.relation_summary(rows, d, ["site_id"])


@query("J15_shared_edge_at_vertex", B.with_ctes(REL, """, vx AS (SELECT site_id, feature_type, id, 2*x0 vx, 2*y0 vy FROM sh),
  near AS (SELECT v.site_id, v.feature_type, v.id target, v.vx, v.vy, e.id nb, min(greatest(0, abs(e.mx-vx) - CASE WHEN hz THEN 1 ELSE 0 END)**2 + greatest(0, abs(e.my-vy) - CASE WHEN hz THEN 0 ELSE 1 END)**2) d2
   FROM vx v JOIN (SELECT *, unnest(range(-8, 9)) o FROM ed) e ON e.site_id=v.site_id AND e.feature_type=v.feature_type AND e.my + o = v.vy AND abs(e.mx-vx) <= 7 AND e.id <> v.id GROUP BY ALL),
  sl AS (SELECT n.*, len FROM near n JOIN (SELECT n.target, n.nb, count(DISTINCT (eb.mx,eb.my))*0.1 len FROM (SELECT DISTINCT target, nb FROM near WHERE d2 <= 36) n JOIN ed ea ON ea.id=n.target JOIN ed eb ON eb.id=n.nb
    WHERE greatest(0, abs(ea.mx-eb.mx) - CASE WHEN ea.hz THEN 1 ELSE 0 END)**2 + greatest(0, abs(ea.my-eb.my) - CASE WHEN ea.hz THEN 0 ELSE 1 END)**2 <= 36 GROUP BY ALL) q USING (target, nb) WHERE d2 <= 36)
  SELECT site_id, feature_type, target, arg_min(nb, (d2, nb)) neighbour, round(sqrt(min(d2))*0.05, 6) distance_m, round(arg_min(len, (d2, nb)),6) length_m, count(*) candidates
  FROM sl WHERE len >= 0.5 - 1e-9 GROUP BY ALL"""))
def vertex_neighbour(spark, folder):
    fp = B.footprints(spark, folder)
    shapes = P.collapse_copies(fp, O.KEYS)
    v = shapes.select(*O.KEYS, F.col("shape_id").alias("target"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"))
    return O.shared_edge_at_vertex(fp, v, B.RES).select(*O.KEYS, "target", "neighbour", "distance_m", F.round("length_m", 6).alias("length_m"), "candidates")


@query("J3_features_in_windows", B.with_ctes(WIN, """SELECT site_id, feature_id, string_agg(w, ',' ORDER BY w) windows FROM
  (SELECT DISTINCT site_id, feature_id, format('W{:02d}', window_id) w FROM pc0) GROUP BY ALL"""))
def in_windows(spark, folder):
    d = B.covered(B.footprints(spark, folder), "feature_id").select("site_id", "id", "spans")
    return O.features_in_windows(d, B.windows(spark, folder)).withColumnRenamed("id", "feature_id")


@query("J9_largest_overlap", B.with_ctes(WIN, """, o AS (SELECT a.site_id, a.label_id, b.feature_id, count(*) inter FROM labc a JOIN cells b USING (site_id, r, c) GROUP BY ALL)
  SELECT l.site_id, l.label_id, coalesce(arg_min(feature_id, (-inter, feature_id)), -1) best, coalesce(max(inter), 0) inter FROM lab l LEFT JOIN o USING (site_id, label_id) GROUP BY ALL"""))
def largest_overlap(spark, folder):
    """Arg-max association; -1 stands for no overlap."""
    from gridfold.plans.scoring import inputs
    preds, labels, _ = inputs(spark, folder)
    two = P.overlap_pairs(preds, labels, ["site_id"]).groupBy("site_id", F.col("b").alias("id")).agg(F.min(F.struct((-F.col("inter")).alias("n"), "a")).alias("m"))
    return labels.join(two, ["site_id", "id"], "left").select("site_id", F.col("id").alias("label_id"), F.coalesce("m.a", F.lit(-1)).alias("best"), F.coalesce(-F.col("m.n"), F.lit(0)).alias("inter"))


@query("J7_distance_to_road", B.with_ctes(B.FP, """, d AS (SELECT site_id, feature_id, greatest(0, 350 - (y0+h), y0 - 350) dh,
   CASE WHEN site_id % 2 = 0 THEN greatest(0, 200 - (x0+w), x0 - 200) END dv FROM fp)
  SELECT site_id, feature_id, CASE WHEN site_id % 4 = 3 THEN NULL ELSE round(least(dh, dv)*0.1, 6) END distance_m FROM d"""))
def road_distance(spark, folder):
    fp = B.footprints(spark, folder)
    return P.nearest_line(fp.withColumn("segs", M.segments(R())), roads(spark, folder), ["site_id"], "feature_id", 4.0).select(
        "site_id", "feature_id", r6(F.col("distance"), "distance_m"))


def roads(spark, folder):
    """One road across each site, a second one in even sites, none where the id leaves 3 modulo 4."""
    sites = B.boxes(spark, folder).select("site_id").distinct().where("site_id % 4 <> 3")
    lines = sites.selectExpr("site_id", "explode(if(site_id % 2 = 0, array(named_struct('x1',0D,'y1',35D,'x2',72D,'y2',35D), named_struct('x1',20D,'y1',0D,'x2',20D,'y2',72D)), array(named_struct('x1',0D,'y1',35D,'x2',72D,'y2',35D)))) s")
    return lines.select("site_id", "s.*")


@query("J8_neighbour_counts", B.with_ctes(B.AREA, """, ce AS (SELECT site_id, feature_id, round((x0 + CASE WHEN lshape THEN (w*h*w/2.0 - (w-w//2)*(h-h//2)*(w//2+(w-w//2)/2.0))/n ELSE w/2.0 END)*0.1, 6) x, round((y0 + CASE WHEN lshape THEN (w*h*h/2.0 - (w-w//2)*(h-h//2)*(h//2+(h-h//2)/2.0))/n ELSE h/2.0 END)*0.1, 6) y FROM ar)
  SELECT a.site_id, a.feature_id, count(*) - 1 neighbours FROM ce a JOIN ce b ON a.site_id=b.site_id AND b.x BETWEEN a.x-3.1 AND a.x+3.1 AND b.y BETWEEN a.y-3.1 AND a.y+3.1
   AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 9.0 + 1e-9 GROUP BY ALL"""))
def neighbours(spark, folder):
    """Centroids within 3 m of each footprint's."""
    pts = pin(B.footprints(spark, folder), c=M.centroid(R())).select("site_id", "feature_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))
    return P.neighbour_counts(pts, ["site_id"], "feature_id", 3.0)


BOUND = WIN + """, am AS (SELECT a.site_id, a.feature_id, b.label_id, count(*) i FROM cells a JOIN labc b USING (site_id, r, c) GROUP BY ALL),
an AS (SELECT site_id, feature_id, count(*) n FROM cells GROUP BY ALL), bn AS (SELECT site_id, label_id, count(*) n FROM labc GROUP BY ALL),
pr AS (SELECT am.site_id, feature_id, label_id FROM am JOIN an USING (site_id, feature_id) JOIN bn USING (site_id, label_id) WHERE i/(an.n+bn.n-i) >= 0.5),
e1 AS (SELECT feature_id id, 2*x0 mx, 2*(y0+dy)+1 my, false hz FROM fp, range(h) t(dy)
  UNION ALL SELECT feature_id, 2*(x0 + CASE WHEN lshape AND dy >= h//2 THEN w//2 ELSE w END), 2*(y0+dy)+1, false FROM fp, range(h) t(dy)
  UNION ALL SELECT feature_id, 2*(x0+dx)+1, 2*y0, true FROM fp, range(w) t(dx)
  UNION ALL SELECT feature_id, 2*(x0+dx)+1, 2*(y0 + CASE WHEN lshape AND dx >= w//2 THEN h//2 ELSE h END), true FROM fp, range(w) t(dx)),
v1 AS (SELECT feature_id id, unnest([x0,x0+w,x0+w,x0,CASE WHEN lshape THEN x0+w//2 ELSE x0 END])*2 vx, unnest([y0,y0,CASE WHEN lshape THEN y0+h//2 ELSE y0+h END,y0+h,CASE WHEN lshape THEN y0+h//2 ELSE y0 END])*2 vy FROM fp
  UNION SELECT feature_id, 2*(x0+w//2), 2*(y0+h) FROM fp WHERE lshape),"""
BOUND += BOUND[BOUND.index("e1 AS"):].replace("e1 AS", "e2 AS").replace("v1 AS", "v2 AS").replace("feature_id", "label_id").replace("FROM fp", "FROM lab").rstrip(",")
DIST = "greatest(0, abs({e}.mx-{p}x) - CASE WHEN {e}.hz THEN 1 ELSE 0 END)**2 + greatest(0, abs({e}.my-{p}y) - CASE WHEN {e}.hz THEN 0 ELSE 1 END)**2"


def _matched_outlines(spark, folder):
    fp, lb = B.footprints(spark, folder), B.labels(spark, folder)
    pr = P.overlap_pairs(B.covered(fp, "feature_id"), B.covered(lb, "label_id"), ["site_id"]).where("inter / (a_cells + b_cells - inter) >= 0.5").select("site_id", "a", "b")
    return (pr.join(dealt(fp.select("site_id", F.col("feature_id").alias("a"), M.segments(R()).alias("pred"))), ["site_id", "a"])
            .join(dealt(lb.select("site_id", F.col("label_id").alias("b"), M.segments(R()).alias("ref"))), ["site_id", "b"]))


@query("A8_boundary_scores", B.with_ctes(BOUND, f""", pe AS (SELECT p.feature_id, p.label_id, e.mx, e.my, min({DIST.format(e='f', p='e.m')}) d FROM pr p JOIN e1 e ON e.id=p.feature_id JOIN e2 f ON f.id=p.label_id GROUP BY ALL),
 re AS (SELECT p.feature_id, p.label_id, e.mx, e.my, min({DIST.format(e='f', p='e.m')}) d FROM pr p JOIN e2 e ON e.id=p.label_id JOIN e1 f ON f.id=p.feature_id GROUP BY ALL)
 SELECT feature_id, label_id, round(p,6) boundary_precision, round(r,6) boundary_recall FROM (SELECT feature_id, label_id, avg(CASE WHEN d <= 4 THEN 1 ELSE 0 END) p FROM pe GROUP BY ALL)
 JOIN (SELECT feature_id, label_id, avg(CASE WHEN d <= 4 THEN 1 ELSE 0 END) r FROM re GROUP BY ALL) USING (feature_id, label_id)"""))
def boundary(spark, folder):
    d = C.boundary_scores(_matched_outlines(spark, folder), 0.1, B.RES)
    return d.select(F.col("a").alias("feature_id"), F.col("b").alias("label_id"), r6(F.col("boundary_precision"), "boundary_precision"), r6(F.col("boundary_recall"), "boundary_recall"))


@query("A9_hausdorff", B.with_ctes(BOUND, f""", hv AS (SELECT feature_id, label_id, max(d) h FROM (
   SELECT p.feature_id, p.label_id, v.vx, v.vy, min({DIST.format(e='f', p='v.v')}) d FROM pr p JOIN v1 v ON v.id=p.feature_id JOIN e2 f ON f.id=p.label_id GROUP BY ALL
   UNION ALL SELECT p.feature_id, p.label_id, v.vx, v.vy, min({DIST.format(e='f', p='v.v')}) d FROM pr p JOIN v2 v ON v.id=p.label_id JOIN e1 f ON f.id=p.feature_id GROUP BY ALL) GROUP BY ALL)
 SELECT feature_id, label_id, round(sqrt(h)*0.05, 6) hausdorff_m FROM hv"""))
def hausdorff(spark, folder):
    d = C.boundary_scores(_matched_outlines(spark, folder), 0.1, B.RES)
    return d.select(F.col("a").alias("feature_id"), F.col("b").alias("label_id"), r6(F.col("hausdorff"), "hausdorff_m"))


@query("R14_gap_slivers", B.with_ctes(GAPS, """SELECT site_id, feature_type, n cells, round(length_m, 6) length_m, count(*) features, min(feature_id) first_feature FROM nr JOIN big USING (site_id, feature_type, g) GROUP BY site_id, feature_type, g, n, length_m HAVING count(*) >= 2""", True))
def gaps(spark, folder):
    d = B.covered(B.footprints(spark, folder), "feature_id").select("site_id", "feature_type", "id", "spans")
    return O.gap_conflicts(d, B.RES).drop("gap").withColumn("length_m", F.round("length_m", 6))


@query("J16_features_near_gaps", B.with_ctes(GAPS, """SELECT site_id, feature_type, g gap, count(*) features FROM nr JOIN big USING (site_id, feature_type, g) GROUP BY ALL HAVING count(*) >= 2""", True))
def near_gaps(spark, folder):
    d = B.covered(B.footprints(spark, folder), "feature_id").select("site_id", "feature_type", "id", "spans")
    return O.gap_conflicts(d, B.RES).select("site_id", "feature_type", "gap", "features")


@query("P13_ring_validity", B.with_ctes(B.FP, """SELECT feature_id, CASE WHEN ok % 53 = 1 THEN 'not_closed,too_few_points' WHEN ok % 51 = 1 THEN 'not_closed' WHEN ok % 50 = 1 THEN 'self_intersection' ELSE '' END faults FROM fp"""))
def validity(spark, folder):
    """Some shapes are broken on purpose: twisted, left open, or cut to three points."""
    fp = B._rings(B.boxes(spark, folder)).withColumn("r", F.col("rings")[0])
    broken = (F.when(F.col("ok") % 53 == 1, F.slice("r", 1, 3)).when(F.col("ok") % 51 == 1, F.slice("r", 1, 4))
              .when(F.col("ok") % 50 == 1, F.array(*[F.col("r")[i] for i in (0, 2, 1, 3, 0)])).otherwise(F.col("r")))
    return fp.select("feature_id", F.array_join(O.ring_faults(F.array(broken)), ",").alias("faults"))


@query("P13_polygon_faults", B.with_ctes(B.FP, """SELECT feature_id, CASE WHEN ok % 53 = 1 THEN 'self_intersection' WHEN ok % 7 = 2 THEN 'hole_outside,rings_cross' WHEN ok % 7 = 3 THEN 'hole_outside'
 WHEN ok % 7 = 4 THEN 'nested_holes' WHEN ok % 7 = 6 THEN 'rings_cross' ELSE '' END faults FROM fp"""))
def polygon_faults(spark, folder):
    """Holes of every kind: inside, across the shell, outside it, in each other, touching in a point, along an edge."""
    from gridfold.operators import validity as V
    fp = B._rings(B.boxes(spark, folder)).withColumn("r", F.col("rings")[0])

    def ring(*pts):
        return F.array(*[F.struct(((F.col("x0") + x) * B.RES).alias("x"), ((F.col("y0") + y) * B.RES).alias("y")) for x, y in (*pts, pts[0])])

    def box(x, y, X, Y):
        return ring((x, y), (X, y), (X, Y), (x, Y))
    k = F.col("ok") % 7
    holes = (F.when(k == 1, F.array(box(.5, .5, 1.5, 1.5))).when(k == 2, F.array(box(-1.0, .5, 1.5, 1.5))).when(k == 3, F.array(box(20.0, .5, 21.0, 1.5)))
             .when(k == 4, F.array(box(.25, .25, 1.75, 1.75), box(.5, .5, 1.5, 1.5))).when(k == 5, F.array(ring((0, 1), (1.0, .5), (1.0, 1.5))))
             .when(k == 6, F.array(box(0, .5, 1.0, 1.5))))
    twisted = F.array(F.array(*[F.col("r")[i] for i in (0, 2, 1, 3, 0)]))
    rings = F.when(F.col("ok") % 53 == 1, twisted).otherwise(F.concat("rings", F.coalesce(holes, F.slice("rings", 2, 1))))
    return V.polygon_faults(fp.select("feature_id", rings.alias("rings")), ["feature_id"]).select("feature_id", F.array_join("faults", ",").alias("faults"))


@query("P12_coordinate_gates", B.with_ctes(B.FP, """SELECT feature_id, CASE WHEN ok % 41 = 1 THEN 'lonlat_range,outside_site' WHEN ok % 43 = 1 THEN 'outside_site' ELSE '' END codes FROM fp"""))
def coordinate_gates(spark, folder):
    fp = B._rings(B.boxes(spark, folder))
    shift = F.when(F.col("ok") % 41 == 1, 400.0).when(F.col("ok") % 43 == 1, 10.0).otherwise(0.0)
    lonlat = F.transform(R(), lambda r: F.transform(r, lambda p: F.struct((p.x / 1e5 - 68.05 + shift).alias("x"), (p.y / 1e5 - 16.53).alias("y"))))
    site = F.struct(F.lit(-68.06).alias("xmin"), F.lit(-16.54).alias("ymin"), F.lit(-68.04).alias("xmax"), F.lit(-16.52).alias("ymax"))
    return fp.select("feature_id", F.array_join(O.coordinate_codes(lonlat, F.lit(True), site), ",").alias("codes"))


@query("P9_seam_distance", B.with_ctes(B.AREA, """, c AS (SELECT feature_id, x0 + CASE WHEN lshape THEN (w*h*w/2.0 - (w-w//2)*(h-h//2)*(w//2+(w-w//2)/2.0))/n ELSE w/2.0 END x, y0 + CASE WHEN lshape THEN (w*h*h/2.0 - (w-w//2)*(h-h//2)*(h//2+(h-h//2)/2.0))/n ELSE h/2.0 END y FROM ar)
 SELECT feature_id, round(least(x%384, 384-x%384, y%384, 384-y%384)*0.1, 6) seam_m FROM c"""))
def seams(spark, folder):
    d = pin(B.footprints(spark, folder), c=M.centroid(R()))
    return d.select("feature_id", F.round(M.seam_distance(F.col("c.x") / 0.1, F.col("c.y") / 0.1, 384, 0.1), 6).alias("seam_m"))


@query("P26_confidence", B.with_ctes(B.FP, """SELECT feature_id, ok % 3 <> 0 has_confidence, CASE WHEN ok % 3 <> 0 THEN round((ok % 100)/100.0, 6) END confidence FROM fp"""))
def confidence(spark, folder):
    score = F.when(F.col("ok") % 3 != 0, (F.col("ok") % 100) / 100.0)
    d = B.boxes(spark, folder).select("feature_id", M.confidence(score, F.lit("mean probability")).alias("c"))
    return d.select("feature_id", F.col("c").isNotNull().alias("has_confidence"), F.round("c.value", 6).alias("confidence"))


@query("P10_projection", B.with_ctes(B.FP, "SELECT site_id, count(*) features, count(*) within_cm FROM fp GROUP BY ALL"))
def projection(spark, folder):
    """Metric coordinates to WGS84 and back, counted where the round trip agrees to a centimetre."""
    x, y = F.col("x0") * 0.1 + 600800.0, F.col("y0") * 0.1 + 8171000.0
    d = B.boxes(spark, folder).select("site_id", x.alias("x"), y.alias("y"))
    d = pin(d, g=G.from_utm(F.col("x"), F.col("y"), 19, True))
    d = pin(d, p=G.to_utm(F.col("g.lon"), F.col("g.lat"), 19, True))
    ok = (F.abs(F.col("p.x") - F.col("x")) < 0.01) & (F.abs(F.col("p.y") - F.col("y")) < 0.01) & F.col("g.lon").between(-69, -68)
    return d.groupBy("site_id").agg(F.count("*").alias("features"), F.count_if(ok).alias("within_cm"))


@query("P11_crs_names", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:32719' WHEN 3 THEN 'EPSG:4326' END crs FROM documents""")
def crs_names(spark, folder):
    raw = F.expr("case doc_id % 5 when 0 then ' crs84 ' when 1 then 'ogc:crs84' when 2 then 'EPSG:32719' when 3 then '' else 'EPSG:3857' end")
    return B.table(spark, folder, "documents").select("doc_id", G.normalise_crs(raw, ["EPSG:4326", "EPSG:32719"]).alias("crs"))


LL = "(feature_id % 36000)/100.0 - 180 + 0.005 AS lon, (feature_id * 7 % 16000)/100.0 - 80 + 0.005 AS lat"
UV = "floor((lon+180)/360*512) AS tx, floor((0.5 - ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*512) AS ty"


@query("F1_quadkey", B.with_ctes(B.FP, f""", q AS (SELECT feature_id, CAST({UV.split(' AS tx')[0]} AS BIGINT) tx, CAST({UV.split('AS tx, ')[1].replace(' AS ty', '')} AS BIGINT) ty FROM (SELECT feature_id, {LL} FROM fp))
 SELECT feature_id, list_aggregate(list_transform(range(8,-1,-1), lambda i: CAST(((tx >> i) & 1) + 2*((ty >> i) & 1) AS VARCHAR)), 'string_agg', '') quadkey FROM q"""))
def quadkeys(spark, folder):
    d = B.boxes(spark, folder).selectExpr("feature_id", *LL.replace("/100.0", "/100D").split(", "))
    return d.select("feature_id", G.quadkey(F.col("lon"), F.col("lat"), 9).alias("quadkey"))


@query("R29_web_tiles", B.with_ctes(B.FP, f"""SELECT CAST(tx AS BIGINT) tile_x, CAST(ty AS BIGINT) tile_y, count(*) features, round(-20037508.342789244 + tx*(2*20037508.342789244/512), 3) xmin FROM (SELECT {UV} FROM (SELECT {LL} FROM fp)) GROUP BY ALL"""))
def web_tiles(spark, folder):
    d = B.boxes(spark, folder).selectExpr("feature_id", *LL.replace("/100.0", "/100D").split(", "))
    d = pin(d, t=G.web_tile(F.col("lon"), F.col("lat"), 9)).groupBy("t").agg(F.count("*").alias("features"))
    return d.select(F.col("t.x").alias("tile_x"), F.col("t.y").alias("tile_y"), "features", F.round(G.tile_bounds(F.lit(9.0), F.col("t.x"), F.col("t.y")).xmin, 3).alias("xmin"))


PYRAMID_Z = 19
PYRAMID = B.RASTER + """, k AS (SELECT 20037508.342789244e0 AS e, 2*20037508.342789244e0/(256*2**19) AS ps),
 c AS (SELECT total*1e0/n v, site_id*100e0 - 7574321.37e0 + (c+0.5e0)*0.43e0 x, (r+0.5e0)*0.43e0 + 1865432.11e0 y FROM raster),
 gx AS (SELECT c.*, e, ps, unnest(range(CAST(ceil((x-0.43e0+e)/ps-0.5e0) AS BIGINT), CAST(floor((x+0.43e0+e)/ps-0.5e0) AS BIGINT)+1)) gx FROM c, k),
 gy AS (SELECT *, unnest(range(CAST(ceil((y-0.43e0+e)/ps-0.5e0) AS BIGINT), CAST(floor((y+0.43e0+e)/ps-0.5e0) AS BIGINT)+1)) gy FROM gx),
 w AS (SELECT *, (1-abs((gx+0.5e0)*ps-e-x)/0.43e0) * (1-abs((gy+0.5e0)*ps-e-y)/0.43e0) w FROM gy),
 l0 AS (SELECT gx, gy, sum(w*v)/sum(w) v FROM w WHERE w > 1e-9 GROUP BY ALL HAVING sum(w) >= 1e-3), l1 AS (SELECT gx>>1 gx, gy>>1 gy, avg(v) v FROM l0 GROUP BY ALL), l2 AS (SELECT gx>>1 gx, gy>>1 gy, avg(v) v FROM l1 GROUP BY ALL),
 al AS (SELECT 19 z, * FROM l0 UNION ALL SELECT 18, * FROM l1 UNION ALL SELECT 17, * FROM l2)"""


@query("R29_tile_content", B.with_ctes(PYRAMID, "SELECT CAST(z AS BIGINT) z, gx//256 x, gy//256 y, gx%256 px, gy%256 py, round(v, 6) AS value FROM al"))
def tile_content(spark, folder):
    """Three levels of web-map tiles over the site rasters, laid side by side on the mercator plane."""
    from gridfold.operators.pyramid import tile_pyramid
    d = B.raster(spark, folder).select("row", "col", (F.col("site_id") * 100.0 - 7574321.37).alias("left"), (F.col("total") * 1.0 / F.col("n")).alias("value"))
    out = tile_pyramid(d, [], F.col("left"), F.lit(-1865432.11), F.lit(0.43), PYRAMID_Z, 3)
    return out.withColumn("value", F.round("value", 6))


@query("L2_feature_page", B.with_ctes(B.FP, "SELECT site_id, feature_id, count(*) OVER () matched FROM fp WHERE feature_type = 'F' ORDER BY feature_id LIMIT 5000 OFFSET 25"))
def feature_page(spark, folder):
    from gridfold.sources.features import page
    return page(B.boxes(spark, folder).where("feature_type = 'F'").select("site_id", "feature_id"), "feature_id", 9000, 25)


@query("A39_layer_summary", B.with_ctes(B.AREA, """SELECT feature_type layer, count(*) features, round(sum(n)*0.01, 4) area_m2, count(*) FILTER (n < 30) small,
  count(*) FILTER (feature_id % 100 < 70) low_score FROM ar GROUP BY ALL"""))
def layer_summary(spark, folder):
    d = pin(B.footprints(spark, folder), a=F.round(M.area(R()) * 100).cast("long"))
    return d.groupBy(F.col("feature_type").alias("layer")).agg(
        F.count("*").alias("features"), F.round(F.sum("a") * 0.01, 4).alias("area_m2"), F.count_if(F.col("a") < 30).alias("small"),
        F.count_if(F.col("feature_id") % 100 < 70).alias("low_score"))


@query("F12_equivalent_diameter", B.with_ctes(B.AREA, "SELECT feature_id, round(2*sqrt(n*0.01/pi()), 6) diameter_m FROM ar"))
def diameter(spark, folder):
    return B.footprints(spark, folder).select("feature_id", r6(M.equivalent_diameter(M.area(R())), "diameter_m"))


@query("F9_affine", B.with_ctes(B.FP, "SELECT feature_id, round(1000 + x0*0.1, 6) x, round(2000 - y0*0.1, 6) y, x0 AS col, y0 AS \"row\" FROM fp"))
def affine(spark, folder):
    d = pin(B.boxes(spark, folder), p=M.pixel_to_map(F.col("x0"), F.col("y0"), F.lit(1000.0), F.lit(2000.0), F.lit(0.1)))
    d = pin(d, q=M.map_to_pixel(F.col("p.x"), F.col("p.y"), F.lit(1000.0), F.lit(2000.0), F.lit(0.1)))
    return d.select("feature_id", r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"), F.round("q.col").cast("long").alias("col"), F.round("q.row").cast("long").alias("row"))


@query("P20_inside_extent", B.with_ctes(B.FP, "SELECT feature_id, x0 >= 10 AND x0+w <= 650 AND y0 >= 0 AND y0+h <= 690 AS inside FROM fp"))
def inside_extent(spark, folder):
    """Declared rectangular extent with 1 mm slack."""
    b = pin(B.footprints(spark, folder), b=M.bounds(R()))
    return b.select("feature_id", ((F.col("b.xmin") >= 1.0 - 1e-3) & (F.col("b.xmax") <= 65.0 + 1e-3) & (F.col("b.ymin") >= -1e-3) & (F.col("b.ymax") <= 69.0 + 1e-3)).alias("inside"))
