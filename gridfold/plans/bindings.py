"""Geometry, rasters, review logs and samples derived from the driver tables.

The tables hold no geometry, so integer formulas derive it; the SQL twins below evaluate the
same formulas in DuckDB.  One cell is 0.1 m.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.operators import spans as S
from gridfold.session import spread

RES = 0.1
WINDOW = 175  # cells
TILE_ROWS = 64
COPY = "1125899906842624L"  # what a copy's id is more than its original's: 2**50, beyond any order key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Footprint parameters: site, id, class, anchor and size in cells; some exact copies (``is_copy``)."""
    base = spread(table(spark, folder, "orders"), "o_orderkey").selectExpr(
        "cast(o_orderkey div 2000 as int) site_id", "o_orderkey feature_id", "o_orderstatus feature_type",
        "cast(o_orderkey * 7919 % 700 as int) x0", "cast((o_custkey * 104729 + o_orderkey * 31) % 700 as int) y0",
        "cast(4 + o_orderkey % 9 as int) w", "cast(4 + o_custkey % 8 as int) h",
        "o_orderkey % 5 = 0 lshape", "o_orderkey ok", "o_custkey ck")
    copies = F.expr("explode(if(ok % 97 = 0, array(false, true), array(false)))")
    return base.withColumn("is_copy", copies).withColumn("feature_id", F.expr(f"feature_id + if(is_copy, {COPY}, 0L)"))


def _rings(df: DataFrame) -> DataFrame:
    """Rectangle, or an L without its upper right part, as a closed ring in metres."""
    def p(x, y):
        return F.struct((F.expr(x) * RES).cast("double").alias("x"), (F.expr(y) * RES).cast("double").alias("y"))
    rect = F.array(p("x0", "y0"), p("x0+w", "y0"), p("x0+w", "y0+h"), p("x0", "y0+h"), p("x0", "y0"))
    ell = F.array(p("x0", "y0"), p("x0+w", "y0"), p("x0+w", "y0+(h div 2)"), p("x0+(w div 2)", "y0+(h div 2)"),
                  p("x0+(w div 2)", "y0+h"), p("x0", "y0+h"), p("x0", "y0"))
    return df.withColumn("rings", F.array(F.when(F.col("lshape"), ell).otherwise(rect)))


def footprints(spark: SparkSession, folder: str) -> DataFrame:
    """All footprints as rings."""
    return _rings(boxes(spark, folder)).select("site_id", "feature_id", "feature_type", "rings")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed labels: footprints moved by up to one cell; some are ignore regions."""
    moved = (boxes(spark, folder).where("ok % 3 <> 0 and not is_copy")
             .withColumn("x0", F.expr("cast(x0 + ck % 3 - 1 as int)")).withColumn("y0", F.expr("cast(y0 + ok % 2 as int)"))
             .withColumn("ignore", F.expr("ok % 11 = 0"))
             .withColumn("window_id", F.expr(f"cast(least(3, greatest(y0, 0) div {WINDOW}) * 4 + least(3, greatest(x0, 0) div {WINDOW}) as int)")))
    return _rings(moved).select("site_id", F.col("feature_id").alias("label_id"), "window_id", "ignore", "rings",
                                F.expr("case ok % 3 when 1 then 'high' else 'medium' end").alias("confidence"))


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Four by four windows per site, in cells (half-open) and in metres."""
    sites = boxes(spark, folder).select("site_id").distinct()
    return (sites.withColumn("wr", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .withColumn("wc", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .selectExpr("site_id", "wr * 4 + wc window_id", f"wr * {WINDOW} r0", f"(wr + 1) * {WINDOW} r1",
                        f"wc * {WINDOW} k0", f"(wc + 1) * {WINDOW} k1"))


def raster(spark: SparkSession, folder: str) -> DataFrame:
    """One 64 x 64 grid per tile: sum and count of quantity per cell (probability = total / n)."""
    return (table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey div 3750 as int) site_id", "cast(l_orderkey % 64 as int) row",
        "cast(l_partkey % 64 as int) col", "cast(l_quantity as bigint) q", "l_partkey", "l_suppkey")
        .groupBy("site_id", "row", "col").agg(
            F.sum("q").alias("total"), F.count("*").alias("n"),
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk")))


def mask(spark: SparkSession, folder: str, threshold: int = 26) -> DataFrame:
    return raster(spark, folder).where(F.col("total") >= threshold * F.col("n")).select("site_id", "row", "col")


def review_events(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only review log: site = user, revision by arrival, 20 features per site."""
    ev = table(spark, folder, "events")
    from gridfold.operators.order import number_in_order
    ev = number_in_order(ev, ["user_id"], ["ts", "event_id"], "revision", block=F.to_date("ts"))
    return ev.selectExpr(
        "user_id site_id", "revision", "event_id", "ts", "event_id % 20 feature",
        "case event_type when 'signup' then 'draw' when 'view' then 'accept' when 'click' then 'reject' "
        "when 'purchase' then 'edit' else 'remove' end operation",
        "cast(value * 100 as bigint) duration_ms", "cast(get_json_object(props, '$.k') as bigint) k")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample manifest: block = source, split by document id, image hash = hash of the text."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id id", "lang site_id", "source block_id",
        "case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'development' else 'evaluation' end split",
        "md5(text) image_sha", "doc_id % 13 <> 0 reviewed", "doc_id % 17 <> 0 labels_locked",
        "cast(doc_id * 37 % 1000 as int) x0", "cast(doc_id * 91 % 1000 as int) y0", "n_chars")


def use_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Attribute rows for the use classifier: four integer attributes, class label, split."""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id id", "cast(vec_id % 5 as int) site_id", "concat('class-', label) use_label",
        "case when vec_id % 10 < 7 then 'train' else 'evaluation' end split",
        *[f"cast(round(embedding[{i}] * 1000) as bigint) f{i}" for i in range(4)])


# ---- the same formulas in DuckDB ----
FP = """
fp AS (SELECT CAST(o_orderkey // 2000 AS BIGINT) site_id, o_orderkey feature_id, o_orderstatus feature_type,
  CAST((o_orderkey*7919) % 700 AS BIGINT) x0, CAST((o_custkey*104729 + o_orderkey*31) % 700 AS BIGINT) y0,
  CAST(4 + o_orderkey % 9 AS BIGINT) w, CAST(4 + o_custkey % 8 AS BIGINT) h, o_orderkey % 5 = 0 lshape,
  o_orderkey ok, o_custkey ck, false is_copy FROM orders
  UNION ALL SELECT CAST(o_orderkey // 2000 AS BIGINT), o_orderkey + 1125899906842624, o_orderstatus,
  CAST((o_orderkey*7919) % 700 AS BIGINT), CAST((o_custkey*104729 + o_orderkey*31) % 700 AS BIGINT),
  CAST(4 + o_orderkey % 9 AS BIGINT), CAST(4 + o_custkey % 8 AS BIGINT), o_orderkey % 5 = 0,
  o_orderkey, o_custkey, true FROM orders WHERE o_orderkey % 97 = 0)"""
CELLS = FP + """,
cells AS (SELECT site_id, feature_id, feature_type, y0 + dy AS r, x0 + dx AS c
  FROM fp, range(w) a(dx), range(h) b(dy) WHERE NOT (lshape AND dx >= w // 2 AND dy >= h // 2))"""
AREA = FP + """,
ar AS (SELECT *, CASE WHEN lshape THEN w*h - (w - w//2)*(h - h//2) ELSE w*h END n FROM fp)"""
# representative (smallest id) of identical shapes inside (site, type)
SHAPES = AREA + """,
sh AS (SELECT site_id, feature_type, x0, y0, w, h, lshape, n, min(feature_id) id, count(*) members
  FROM ar GROUP BY ALL),
shc AS (SELECT site_id, feature_type, id, y0 + dy AS r, x0 + dx AS c
  FROM sh, range(w) a(dx), range(h) b(dy) WHERE NOT (lshape AND dx >= w // 2 AND dy >= h // 2))"""
LABELS = FP + f""",
lab AS (SELECT *, CAST(least(3, greatest(y0,0) // {WINDOW})*4 + least(3, greatest(x0,0) // {WINDOW}) AS BIGINT) window_id FROM
  (SELECT site_id, feature_id label_id, x0 + ck % 3 - 1 AS x0, y0 + ok % 2 AS y0, w, h, lshape, ok % 11 = 0 ign,
     CASE ok % 3 WHEN 1 THEN 'high' ELSE 'medium' END confidence
   FROM fp WHERE ok % 3 <> 0 AND NOT is_copy)),
labc AS (SELECT site_id, label_id, window_id, ign, y0 + dy AS r, x0 + dx AS c
  FROM lab, range(w) a(dx), range(h) b(dy) WHERE NOT (lshape AND dx >= w // 2 AND dy >= h // 2))"""
RASTER = """
raster AS (SELECT CAST(l_orderkey // 3750 AS BIGINT) site_id, CAST(l_orderkey % 64 AS BIGINT) r, CAST(l_partkey % 64 AS BIGINT) c,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) total, count(*) n, min(l_partkey) pk, min(l_suppkey) sk
  FROM lineitem GROUP BY ALL)"""
MASK = RASTER + """,
m AS (SELECT site_id, r, c FROM raster WHERE total >= 26 * n)"""
# connected components of m (label = smallest row*64+col)
COMPONENTS = MASK + """,
e AS (SELECT a.site_id, a.r*64+a.c u, b.r*64+b.c v FROM m a JOIN m b ON a.site_id = b.site_id
  AND ((a.r = b.r AND abs(a.c-b.c) = 1) OR (a.c = b.c AND abs(a.r-b.r) = 1))),
reach AS (SELECT site_id, r*64+c u, r*64+c v FROM m UNION SELECT k.site_id, k.u, e.v FROM reach k JOIN e ON e.site_id = k.site_id AND e.u = k.v),
comp AS (SELECT site_id, u // 64 r, u % 64 c, min(v) component FROM reach GROUP BY site_id, u)"""


def walks(edges: str, keys: str, to: str = "") -> str:
    """CTEs that follow the edge table ``edges`` (keys, u, v, l) edge by edge: ``walked`` holds every line with its
    vertices (keys, first, second, pos, node, along, behind, ahead), one direction each."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    k, hk, wk = keys, ", ".join(f"h.{x}" for x in keys.split(", ")), ", ".join(f"w.{x}" for x in keys.split(", "))
    return f""", hf{to} AS (SELECT {k}, u, v, l FROM {edges} UNION ALL SELECT {k}, v, u, l FROM {edges}), dn{to} AS (SELECT {k}, u node, count(*) d FROM hf{to} GROUP BY ALL),
 hd{to} AS (SELECT {hk}, u, v, l, a.d du, b.d dv FROM hf{to} h JOIN dn{to} a ON {on("a", "h")} AND a.node = h.u JOIN dn{to} b ON {on("b", "h")} AND b.node = h.v),
 wp{to} AS (SELECT {hk}, u f, v s, u, v, CAST(0 AS BIGINT) pos, CAST(0 AS DOUBLE) before, l, dv FROM hd{to} h WHERE du <> 2
   UNION ALL SELECT {wk}, f, s, h.u, h.v, pos + 1, before + w.l, h.l, h.dv FROM wp{to} w JOIN hd{to} h ON {on("h", "w")} AND h.u = w.v AND h.v <> w.u WHERE w.dv = 2),
 wc{to} AS (SELECT {hk}, h.u f, h.v s, h.u, h.v, CAST(0 AS BIGINT) pos, CAST(0 AS DOUBLE) before, h.l FROM hd{to} h LEFT JOIN wp{to} w ON {on("w", "h")} AND w.u = h.u AND w.v = h.v WHERE w.f IS NULL
   UNION ALL SELECT {wk}, f, s, h.u, h.v, pos + 1, before + w.l, h.l FROM wc{to} w JOIN hd{to} h ON {on("h", "w")} AND h.u = w.v AND h.v <> w.u WHERE w.v > f),
 wl{to} AS (SELECT {k}, f, s, u, v, pos, before, l FROM wp{to} UNION ALL SELECT {k}, f, s, u, v, pos, before, l FROM wc{to} QUALIFY bool_or(v = f) OVER (PARTITION BY {k}, f, s)),
 wo{to} AS (SELECT *, max_by(u, pos) OVER w lu, max_by(v, pos) OVER w lv, max(pos) OVER w + 1 edges FROM wl{to} WINDOW w AS (PARTITION BY {k}, f, s)),
 walked{to} AS (SELECT {k}, f AS first, s AS second, pos + 1 AS pos, v AS node, before + l AS along, u AS behind, lead(v) OVER (PARTITION BY {k}, f, s ORDER BY pos) AS ahead FROM wo{to} WHERE f < lv OR f = lv AND s <= lu
   UNION ALL SELECT {k}, f, s, 0, f, CAST(0 AS DOUBLE), NULL, s FROM wo{to} WHERE pos = 0 AND (f < lv OR f = lv AND s <= lu))"""


def thinned(mask: str, to: str = "") -> str:
    """CTEs of the published two-subiteration thinning of ``mask`` (site_id, r, c): ``thin`` holds what stays."""
    near = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # clockwise from north
    code = " + ".join(f"CASE WHEN b.r = a.r + {dr} AND b.c = a.c + {dc} THEN {1 << i} ELSE 0 END" for i, (dr, dc) in enumerate(near))
    return f""", tp{to} AS (SELECT site_id, r, c, 0 k, false gone, true active FROM {mask}
   UNION ALL SELECT site_id, r, c, k + 1, CASE WHEN k % 2 = 0 THEN dels > 0 ELSE false END, CASE WHEN k % 2 = 0 THEN true ELSE gone OR dels > 0 END
   FROM (SELECT *, count(*) FILTER (del) OVER (PARTITION BY site_id) dels FROM (SELECT *, bit_count(w) BETWEEN 2 AND 6 AND bit_count((~w & 255) & ((w >> 1) | ((w & 1) << 7))) = 1
       AND CASE WHEN k % 2 = 0 THEN w & 21 <> 21 AND w & 84 <> 84 ELSE w & 69 <> 69 AND w & 81 <> 81 END del
     FROM (SELECT a.site_id, a.r, a.c, a.k, a.gone, CAST(sum({code}) AS INTEGER) w
           FROM (SELECT * FROM tp{to} WHERE active) a JOIN tp{to} b ON b.site_id = a.site_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL))) WHERE NOT del),
 thin{to} AS (SELECT site_id, r, c FROM tp{to} WHERE NOT active)"""


def touching(cells: str, to: str = "") -> str:
    """CTE of 8-neighbour edges ``ed`` (site_id, u, v, l, r, c, r2, c2) of a cell table."""
    return f""", ed{to} AS (SELECT a.site_id, a.r*2147483648+a.c u, b.r*2147483648+b.c v, sqrt(abs(a.r-b.r)+abs(a.c-b.c)) l, a.r, a.c, b.r r2, b.c c2
   FROM {cells} a JOIN {cells} b ON a.site_id=b.site_id AND ((b.r=a.r AND b.c=a.c+1) OR (b.r=a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1)))"""


EVENTS = """
ev AS (SELECT user_id site_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) revision, event_id, ts,
  event_id % 20 feature, CASE event_type WHEN 'signup' THEN 'draw' WHEN 'view' THEN 'accept' WHEN 'click' THEN 'reject'
  WHEN 'purchase' THEN 'edit' ELSE 'remove' END operation, CAST(floor(value * 100) AS BIGINT) duration_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events)"""
SAMPLES = """
sm AS (SELECT doc_id id, lang site_id, source block_id,
  CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'development' ELSE 'evaluation' END split,
  md5(text) image_sha, doc_id % 13 <> 0 reviewed, doc_id % 17 <> 0 labels_locked,
  CAST(doc_id * 37 % 1000 AS BIGINT) x0, CAST(doc_id * 91 % 1000 AS BIGINT) y0, n_chars FROM documents)"""
USE = """
us AS (SELECT vec_id id, CAST(vec_id % 5 AS BIGINT) site_id, 'class-' || label use_label,
  CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'evaluation' END split,
  """ + ", ".join(f"CAST(round(embedding[{i + 1}] * 1000) AS BIGINT) f{i}" for i in range(4)) + " FROM embeddings)"


def with_ctes(ctes: str, body: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()} {body.strip()}"


def covered(df: DataFrame, id_col: str, res: float = RES) -> DataFrame:
    """Coverage with the id renamed to ``id`` (the form the pair operators take)."""
    return S.coverage(df, res).withColumnRenamed(id_col, "id")


def areas(df: DataFrame) -> DataFrame:
    return df.withColumn("area_m2", M.area(F.col("rings")))
