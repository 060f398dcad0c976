"""Quality, protocol and classifier queries with SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.operators import classify as L
from gridfold.operators import pairs as P
from gridfold.operators import quality as Q
from gridfold.operators import scoring as C
from gridfold.operators import spans as S
from gridfold.plans import bindings as B
from gridfold.plans.registry import query
from gridfold.plans.scoring import WIN, inputs
from gridfold.plans.topology import R, roads
from gridfold.session import cut, pin, scratch

FE = ["f0", "f1", "f2", "f3"]


def boxed(spark, folder):
    return B.samples(spark, folder).selectExpr("*", "cast(x0 as double) xmin", "cast(y0 as double) ymin", "x0 + 10D xmax", "y0 + 10D ymax")


def _leak_sql(op, buffer):
    return f""", one AS (SELECT site_id, split, x0, y0, min(id) id, count(*) n FROM sm GROUP BY ALL),
 lk AS (SELECT a.site_id, least(a.id,b.id) a, greatest(a.id,b.id) b, a.n*b.n pairs FROM one a JOIN one b ON a.site_id=b.site_id AND a.split < b.split
  WHERE (least(a.x0,b.x0)+10 > greatest(a.x0,b.x0) AND least(a.y0,b.y0)+10 > greatest(a.y0,b.y0))
   OR greatest(0, abs(a.x0-b.x0)-10)**2 + greatest(0, abs(a.y0-b.y0)-10)**2 {op} {buffer * buffer})"""


@query("J11_split_leaks", B.with_ctes(B.SAMPLES + _leak_sql("<", 20), "SELECT * FROM lk"))
def leaks(spark, folder):
    return Q.split_leaks(boxed(spark, folder), ["site_id"], 20.0, False, 64.0)


@query("J12_use_split_leaks", B.with_ctes(B.SAMPLES + _leak_sql("<=", 20), "SELECT * FROM lk"))
def use_leaks(spark, folder):
    return Q.split_leaks(boxed(spark, folder), ["site_id"], 20.0, True, 64.0)


def _checks(**kw):
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) = 0 passed, count(*) detail FROM ({v})" for k, v in kw.items())


MANIFEST = dict(unique_ids="SELECT id FROM sm GROUP BY id HAVING count(*) > 1", all_splits_present="SELECT unnest(['train','development','evaluation']) s EXCEPT SELECT split FROM sm",
                known_splits="SELECT 1 FROM sm WHERE split NOT IN ('train','development','evaluation')", labels_reviewed="SELECT 1 FROM sm WHERE NOT reviewed",
                evaluation_locked="SELECT 1 FROM sm WHERE split='evaluation' AND NOT labels_locked", block_in_one_split="SELECT 1 FROM sm GROUP BY site_id, block_id HAVING count(DISTINCT split) > 1",
                image_in_one_split="SELECT 1 FROM sm GROUP BY image_sha HAVING count(DISTINCT split) > 1", spatial_separation="SELECT 1 FROM lk")


@query("Q3_manifest_protocol", B.with_ctes(B.SAMPLES + _leak_sql("<", 20), _checks(**MANIFEST)))
def manifest_protocol(spark, folder):
    s = boxed(spark, folder)
    return Q.manifest_protocol(s, Q.split_leaks(s, ["site_id"], 20.0, False, 64.0))


@query("U6_cross_split_keys", B.with_ctes(B.SAMPLES, """SELECT 'block' kind, site_id || ':' || block_id AS key, count(DISTINCT split) splits FROM sm GROUP BY ALL HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'image', image_sha, count(DISTINCT split) FROM sm GROUP BY ALL HAVING count(DISTINCT split) > 1"""))
def cross_split(spark, folder):
    s = B.samples(spark, folder)
    a = Q.across_splits(s, ["site_id", "block_id"]).select(F.lit("block").alias("kind"), F.concat_ws(":", "site_id", "block_id").alias("key"), "splits")
    return a.unionByName(Q.across_splits(s, ["image_sha"]).select(F.lit("image").alias("kind"), F.col("image_sha").alias("key"), "splits"))


USEP = B.SAMPLES + _leak_sql("<=", 20) + """, us AS (SELECT *, CASE id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'home' WHEN 2 THEN 'shop' ELSE 'farm' END use_label,
  CASE WHEN id % 19 = 0 THEN [] ELSE ['e'] END evidence, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN -1 ELSE id % 31 END f0, CAST(n_chars AS DOUBLE) f1 FROM sm)"""


@query("Q4_use_protocol", B.with_ctes(USEP, _checks(unique_ids="SELECT 1 FROM us GROUP BY site_id, id HAVING count(*) > 1", all_splits_present="SELECT unnest(['train','development','evaluation']) s EXCEPT SELECT split FROM us",
       block_in_one_split="SELECT 1 FROM us GROUP BY site_id, block_id HAVING count(DISTINCT split) > 1", geometry_in_one_split="SELECT 1 FROM us GROUP BY image_sha HAVING count(DISTINCT split) > 1",
       reviewed_with_evidence="SELECT 1 FROM us WHERE NOT reviewed OR len(evidence) = 0", declared_labels="SELECT 1 FROM us WHERE use_label NOT IN ('home','shop','unknown') OR (split='train' AND use_label='unknown')",
       finite_attributes="SELECT 1 FROM us WHERE f0 < 0", train_attributes="SELECT 1 FROM us WHERE split='train' AND f0 IS NULL", spatial_separation="SELECT 1 FROM lk")))
def use_protocol(spark, folder):
    s = boxed(spark, folder)
    u = s.withColumn("use_label", F.expr("case id % 4 when 0 then 'unknown' when 1 then 'home' when 2 then 'shop' else 'farm' end")).withColumn(
        "evidence", F.expr("if(id % 19 = 0, array(), array('e'))")).withColumn("f0", F.expr("case when id % 23 = 0 then null when id % 29 = 0 then -1D else cast(id % 31 as double) end")).withColumn(
        "f1", F.col("n_chars").cast("double")).withColumnRenamed("image_sha", "geometry_sha")
    return Q.use_protocol(u, Q.split_leaks(s, ["site_id"], 20.0, True, 64.0), ["home", "shop"], ["f0", "f1"])


@query("S9_hash_inventory", """SELECT status, count(*) files FROM (SELECT CASE WHEN page_id % 11 = 3 THEN 'missing' WHEN page_id % 13 = 5 THEN 'unlisted' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'checked' END status FROM pages) GROUP BY ALL""")
def hash_inventory(spark, folder):
    """Files are the page texts; some are absent, some unlisted, some differ from the list."""
    p = B.table(spark, folder, "pages").withColumn("path", F.concat("url", F.lit("#"), "page_id"))
    have = p.where("page_id % 11 <> 3").select("path", F.sha2("html", 256).alias("sha256"))
    want = p.where("page_id % 11 = 3 or page_id % 13 <> 5").select("path", F.sha2(F.expr("if(page_id % 7 = 0, concat(html, '!'), html)"), 256).alias("sha256"))
    return Q.hash_inventory(want, have).groupBy("status").agg(F.count("*").alias("files"))


@query("Q7_frozen_inventory", """WITH b AS (SELECT DISTINCT page_id // 10 k FROM pages) SELECT count(*) FILTER (k % 7 = 0) changed, count(*) FILTER (k % 7 <> 0) checked, count(*) FILTER (k % 7 = 0) = 0 AS passed FROM b""")
def frozen_inventory(spark, folder):
    """Blocks of page texts written as files by Spark, then hashed from the files."""
    path = scratch(spark, "frozen")
    p = B.table(spark, folder, "pages").selectExpr("page_id", "page_id div 10 block", "base64(encode(html, 'UTF-8')) line")
    docs = p.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda s: s.line), "\n").alias("value"))
    docs.write.partitionBy("block").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    have = files.select(F.regexp_extract("path", r"block=(\d+)", 1).alias("path"), F.sha2("content", 256).alias("sha256"))
    listed = F.concat(F.expr("if(block % 7 = 0, concat(value, '!'), value)"), F.lit("\n"))
    want = docs.select(F.col("block").cast("string").alias("path"), F.sha2(listed, 256).alias("sha256"))
    return Q.hash_inventory(want, have).agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "checked").alias("checked"),
                                            (F.count_if(F.col("status") != "checked") == 0).alias("passed"))


@query("Q9_frozen_chain", """SELECT lang, count(*) FILTER (doc_id % 10 = 0) mismatches, count(*) FILTER (doc_id % 10 = 0) = 0 AS passed FROM documents GROUP BY ALL""")
def frozen_chain(spark, folder):
    d = B.table(spark, folder, "documents").select("lang", F.col("doc_id").cast("string").alias("item"), "doc_id", "text")
    rec = d.select("lang", "item", F.sha2("text", 256).alias("sha256"))
    act = d.where("doc_id % 20 <> 10").select("lang", "item", F.sha2(F.expr("if(doc_id % 20 = 0, concat(text, '!'), text)"), 256).alias("sha256"))
    return Q.frozen_chain(rec, act, ["lang"])


@query("J4_decision_coverage", """SELECT doc_id cut, CASE WHEN doc_id % 10 = 1 THEN 'undecided' WHEN doc_id % 10 = 2 THEN 'repeated' ELSE 'unknown_id' END problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)""")
def decision_coverage(spark, folder):
    d = B.table(spark, folder, "documents").select(F.col("doc_id").alias("cut"))
    rec = d.where("cut % 10 <> 1").select("cut").unionByName(d.where("cut % 10 = 2").select("cut"))
    return Q.full_coverage(rec, d.where("cut % 10 <> 3"), "cut")


@query("U1_decision_ids", "SELECT doc_id, 'left' side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def decision_ids(spark, folder):
    return Q.same_keys(B.table(spark, folder, "documents").select("doc_id"), B.table(spark, folder, "labels").select("doc_id"))


REVIEW = "CASE ok % 11 WHEN 0 THEN 'keep_ignore' WHEN 1 THEN 'edit' WHEN 2 THEN 'uncertain' ELSE 'confirm' END"


@query("U2_review_integrity", B.with_ctes(WIN, f""", dec AS (SELECT feature_id label_id, {REVIEW} decision FROM fp WHERE ok % 3 <> 0 AND NOT is_copy), rv AS (SELECT l.*, decision FROM lab l JOIN dec USING (label_id))
 SELECT 'buildings_match' AS "check", count(*) detail FROM (SELECT 1 FROM rv WHERE (decision IN ('confirm','edit')) <> (NOT ign))
 UNION ALL SELECT 'edits_recorded', count(*) FROM (SELECT label_id FROM rv WHERE decision='edit' EXCEPT SELECT label_id FROM rv WHERE decision='edit' AND label_id % 5 <> 0)
 UNION ALL SELECT 'ignored_cells_on_buildings', count(*) FROM (SELECT site_id, r, c FROM labc WHERE ign INTERSECT SELECT site_id, r, c FROM labc WHERE NOT ign)"""))
def review_integrity(spark, folder):
    lab = inputs(spark, folder)[1]
    rv = lab.withColumn("decision", F.expr("case id % 11 when 0 then 'keep_ignore' when 1 then 'edit' when 2 then 'uncertain' else 'confirm' end"))
    building = F.col("decision").isin("confirm", "edit")
    edits = rv.where("decision = 'edit'").select("id")
    on = S.overlay({"i": S.explode_spans(lab.where("ignore"), "site_id"), "b": S.explode_spans(lab.where("not ignore"), "site_id")}, ["site_id"])

    def row(name, df, col):
        return df.agg(col.alias("detail")).select(F.lit(name).alias("check"), "detail")
    return (row("buildings_match", rv.where(building == F.col("ignore")), F.count("*"))
            .unionByName(row("edits_recorded", edits.exceptAll(edits.where("id % 5 <> 0")), F.count("*")))
            .unionByName(row("ignored_cells_on_buildings", on.where("i > 0 and b > 0"), F.coalesce(F.sum(S.span_cells()), F.lit(0).cast("long")))))


@query("Q2_label_verification", B.with_ctes(WIN, f""", rv AS (SELECT l.*, {REVIEW.replace('ok', 'label_id')} decision FROM lab l)
 SELECT site_id, count(*) labels, count(*) FILTER (decision IN ('confirm','edit') AND ign) ignored_buildings, count(*) FILTER (decision IN ('uncertain','keep_ignore') AND NOT ign) kept_uncertain FROM rv GROUP BY ALL"""))
def label_verification(spark, folder):
    rv = B.labels(spark, folder).withColumn("decision", F.expr("case label_id % 11 when 0 then 'keep_ignore' when 1 then 'edit' when 2 then 'uncertain' else 'confirm' end"))
    return rv.groupBy("site_id").agg(F.count("*").alias("labels"), F.count_if(F.col("decision").isin("confirm", "edit") & F.col("ignore")).alias("ignored_buildings"),
                                     F.count_if(F.col("decision").isin("uncertain", "keep_ignore") & ~F.col("ignore")).alias("kept_uncertain"))


@query("J6_ignore_minus_labels", B.with_ctes(WIN, """, keep AS (SELECT DISTINCT site_id, r, c FROM labc WHERE NOT ign)
 SELECT a.site_id, label_id, count(*) cells FROM labc a ANTI JOIN keep USING (site_id, r, c) WHERE ign GROUP BY ALL HAVING count(*) > 1"""))
def ignore_minus_labels(spark, folder):
    lab = inputs(spark, folder)[1]
    keep = S.union_spans(S.explode_spans(lab.where("not ignore"), "site_id"), ["site_id"])
    ign = lab.where("ignore")
    hit = S.overlap_with(S.explode_spans(ign, "site_id", "id"), keep, ["site_id"], ["site_id", "id"])
    left = ign.join(hit, ["site_id", "id"], "left").withColumn("cells", F.col("cells") - F.coalesce("covered", F.lit(0)))
    return left.where("cells > 1").select("site_id", F.col("id").alias("label_id"), "cells")


@query("Q1_layer_validator", B.with_ctes(B.AREA, """SELECT site_id, count(*) features, count(*) FILTER (n < 30) below_min_area, count(*) FILTER (x0+w > 700 OR y0+h > 700) outside, CAST(sum(n) AS BIGINT) vector_cells, 0 AS invalid, true AS round_trip FROM ar GROUP BY ALL""".replace("0 AS invalid", "CAST(0 AS BIGINT) AS invalid")))
def layer_validator(spark, folder):
    """Counts, bounds, minimum area, validity, and vector against mask cells."""
    from gridfold.operators import topology as O
    d = B.covered(B.footprints(spark, folder), "feature_id")
    d = pin(d, a=M.area(R()), b=M.bounds(R()), f=O.ring_faults(R()))
    return d.groupBy("site_id").agg(
        F.count("*").alias("features"), F.count_if(F.col("a") < 0.3 - 1e-9).alias("below_min_area"),
        F.count_if((F.col("b.xmax") > 70 + 1e-6) | (F.col("b.ymax") > 70 + 1e-6)).alias("outside"), F.sum("cells").alias("vector_cells"),
        F.count_if(F.size("f") > 0).alias("invalid"), F.bool_and(F.abs(F.col("a") * 100 - F.col("cells")) <= 0.15 * F.col("cells")).alias("round_trip"))


MASKED = B.AREA + """, ce AS (SELECT site_id, ok, y0+dy r, x0+dx c FROM fp, range(w) a(dx), range(h) b(dy) WHERE NOT (lshape AND dx >= w // 2 AND dy >= h // 2)),
 mk AS (SELECT DISTINCT site_id, r, c + CASE WHEN ok % 10 = 1 THEN 1 ELSE 0 END c, true m FROM ce WHERE ok % (CASE WHEN site_id % 2 = 0 THEN 4 ELSE 20 END) <> 0), bu AS (SELECT DISTINCT site_id, r, c, true v FROM ce),
 io AS (SELECT site_id, count(*) FILTER (m AND v) / count(*) iou FROM bu FULL JOIN mk USING (site_id, r, c) GROUP BY ALL),
 pt AS (SELECT *, (2*y0+h-1)//2 r, x0 + (CASE WHEN lshape AND (2*y0+h-1)//2 - y0 >= h//2 THEN w//2 ELSE w END)//2 c FROM ar),
 st AS (SELECT site_id, CASE WHEN site_id % 5 = 0 THEN 1 ELSE 0 END missing, count(*) FILTER (ok % 61 = 2) invalid, count(*) FILTER (x0+w > 700 OR y0+h > 700) beyond, count(*) FILTER (n < 20) small,
  count(*) FILTER (site_id % 3 = 0 AND r < 700 AND c < 700 AND (r*31+c) % 97 = 5) dark FROM pt GROUP BY ALL),
 un AS (SELECT site_id, unnest([{c: 'feature_count', d: missing}, {c: 'valid', d: invalid}, {c: 'inside_bounds', d: beyond}, {c: 'min_area', d: small}, {c: 'interior_points', d: dark}]) u FROM st)"""


@query("Q1_layer_checks", B.with_ctes(MASKED, """SELECT site_id, u.c AS "check", u.d = 0 AS passed, CAST(u.d AS DOUBLE) detail FROM un UNION ALL SELECT site_id, 'round_trip', iou >= 0.85, round(iou, 6) FROM io"""))
def layer_checks(spark, folder):
    """Every check fails somewhere: counts off by one, a hole in a hole, shapes over the edge or
    small, a mask that misses a quarter, points on cells without data."""
    from gridfold.operators import validity as V
    whole = B._rings(B.boxes(spark, folder))

    def hole(a, b):  # inside the first cell, off its centre
        pts = [F.struct(((F.col("x0") + x) * B.RES).alias("x"), ((F.col("y0") + y) * B.RES).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
        return F.array(*pts)
    d = whole.withColumn("rings", F.when(F.col("ok") % 61 == 2, F.concat("rings", F.array(hole(.1, .4), hole(.2, .3)))).otherwise(F.col("rings")))
    spans = S.explode_spans(S.coverage(whole.select("site_id", "ok", "feature_id", "rings").where("ok % if(site_id % 2 = 0, 4, 20) <> 0"), B.RES), "site_id", "ok")
    mask = spans.select("site_id", "row", *[F.expr(f"cast({c} + if(ok % 10 = 1, 1, 0) as int)").alias(c) for c in ("c0", "c1")])
    sites = whole.groupBy("site_id").agg((F.count("*") - F.expr("if(site_id % 5 = 0, 1, 0)")).alias("features")).select(
        "*", F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(70.0).alias("xmax"), F.lit(70.0).alias("ymax"))
    nodata = (sites.where("site_id % 3 = 0").select("site_id", F.explode(F.sequence(F.lit(0), F.lit(699))).alias("row"))
              .withColumn("col", F.explode(F.expr("sequence(pmod(5 - row * 31, 97), 699, 97)"))))
    return V.layer_checks(d, mask, nodata, sites, ["site_id"], B.RES, 0.195).withColumn("detail", F.round("detail", 6))


@query("Q10_elevation_gate", """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'dsm_not_single_band' END, CASE WHEN doc_id % 14 IN (0, 1) THEN 'dsm_does_not_cover_imagery' END,
 CASE WHEN n_chars % 3 <> 0 OR doc_id % 11 = 0 THEN 'dsm_requires_explicit_alignment' END, CASE WHEN doc_id % 9 <> 0 THEN 'dsm_vertical_units_unverified' END) flags FROM documents WHERE doc_id % 9 <> 0
 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id % 9 = 0""")
def elevation_gate(spark, folder):
    """A surface model beside each image: bands, cover, grid, units; one of nine has none."""
    def box(xmin, xmax):
        return F.struct(F.lit(xmin).alias("xmin"), F.lit(-16.6).alias("ymin"), xmax.alias("xmax"), F.lit(-16.5).alias("ymax"))
    image = box(-68.1, F.lit(-68.0))
    model = F.when(F.expr("doc_id % 9 <> 0"), box(-68.1, F.expr("if(doc_id % 14 in (0, 1), -68.05D, -67.9D)")))
    grid = F.struct(F.expr("if(doc_id % 11 = 0, 'EPSG:4326', 'EPSG:32719')").alias("crs"), F.expr("n_chars % 3").cast("int").alias("shift"))
    same = F.struct(F.lit("EPSG:32719").alias("crs"), F.lit(0).alias("shift"))
    d = pin(B.table(spark, folder, "documents").select("doc_id", "n_chars"), m=model, i=image, g=grid)
    return d.select("doc_id", F.array_join(Q.elevation_flags("dsm", F.expr("if(doc_id % 6 = 0, 3, 1)"), F.col("m"), F.col("i"), F.col("g"), same), ",").alias("flags"))


@query("Q10_raster_gate", """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 17 = 0 THEN 'not_georeferenced' END, CASE WHEN doc_id % 5 < 1 THEN 'needs_rgb_uint8' END, CASE WHEN doc_id % 19 = 0 THEN 'bounds' END,
 CASE WHEN n_chars % 101 = 0 THEN 'empty' END, CASE WHEN doc_id % 23 = 0 THEN 'source_licence_unverified' END) flags FROM documents""")
def raster_gate(spark, folder):
    b = F.struct(F.lit(-68.1).alias("xmin"), F.lit(-16.6).alias("ymin"), F.expr("if(doc_id % 19 = 0, -70.0D, -68.0D)").alias("xmax"), F.lit(-16.5).alias("ymax"))
    fl = Q.raster_flags(F.expr("if(doc_id % 17 = 0, '', 'EPSG:32719')"), F.expr("if(doc_id % 5 < 1, 1, 3)"), F.lit("uint8"), b, F.expr("n_chars % 101"), F.expr("if(doc_id % 23 = 0, ' Unknown', 'CC')"))
    return B.table(spark, folder, "documents").select("doc_id", F.array_join(fl, ",").alias("flags"))


CONF = """cf AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 255 ELSE quality + toxic END ref, doc_id % 3 pred FROM documents JOIN labels USING (doc_id)),
 cm AS (SELECT lang, ref, pred, count(n) n FROM (SELECT DISTINCT lang FROM cf) CROSS JOIN range(3) a(ref) CROSS JOIN range(3) b(pred) LEFT JOIN (SELECT lang, ref, pred, 1 n FROM cf) USING (lang, ref, pred) GROUP BY ALL),
 cs AS (SELECT lang, k class_id, sum(CASE WHEN ref=k THEN n ELSE 0 END) actual, sum(CASE WHEN pred=k THEN n ELSE 0 END) predicted, sum(CASE WHEN ref=k AND pred=k THEN n ELSE 0 END) tp FROM cm, range(3) t(k) GROUP BY ALL)"""


def confusion_rows(spark, folder):
    d = B.table(spark, folder, "documents").join(B.table(spark, folder, "labels"), "doc_id")
    return d.selectExpr("lang", "source", "if(doc_id % 7 = 0, 255, quality + toxic) ref", "cast(doc_id % 3 as int) pred")


@query("A2_confusion", B.with_ctes(CONF, "SELECT lang, ref, pred, n, true AS valid FROM cm"))
def confusion(spark, folder):
    return C.confusion(confusion_rows(spark, folder), spark.range(3).select(F.col("id").cast("int").alias("class_id")), ["lang"])


@query("A3_class_scores", B.with_ctes(CONF, """SELECT lang, class_id, CAST(actual AS BIGINT) actual, CAST(predicted AS BIGINT) predicted, CAST(tp AS BIGINT) tp, round(tp/nullif(actual+predicted-tp,0), 8) iou, round(tp/nullif(predicted,0), 8) precision_,
 round(tp/nullif(actual,0), 8) recall, round(2*tp/nullif(actual+predicted,0), 8) f1, round(avg(tp/nullif(actual+predicted-tp,0)) OVER (PARTITION BY lang), 8) macro_iou FROM cs"""))
def class_scores(spark, folder):
    out = C.class_scores(confusion(spark, folder).select("lang", "ref", "pred", "n"), ["lang"]).withColumnRenamed("precision", "precision_")
    return out.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("A18_block_scores", """WITH cf AS (SELECT lang || ':' || source AS block, CASE WHEN doc_id % 7 = 0 THEN 255 ELSE quality + toxic END ref, doc_id % 3 pred FROM documents JOIN labels USING (doc_id))
 SELECT coalesce(block, 'all') AS block, count(*) evaluated, count(*) FILTER (ref = pred) correct, round(count(*) FILTER (pred = 2) / count(*), 8) unknown_fraction FROM cf WHERE ref <> 255 GROUP BY GROUPING SETS ((block), ())""")
def block_scores(spark, folder):
    d = confusion_rows(spark, folder).where("ref <> 255").withColumn("block", F.concat_ws(":", "lang", "source"))
    g = d.groupingSets([["block"], []], "block").agg(F.count("*").alias("evaluated"), F.count_if(F.col("ref") == F.col("pred")).alias("correct"), F.count_if(F.col("pred") == 2).alias("u"))
    return g.select(F.coalesce("block", F.lit("all")).alias("block"), "evaluated", "correct", F.round(F.col("u") / F.col("evaluated"), 8).alias("unknown_fraction"))


@query("A18_block_class_scores", """WITH cf AS (SELECT unnest([lang || ':' || source, 'all']) AS block, CASE WHEN doc_id % 7 = 0 THEN 255 ELSE quality + toxic END ref, doc_id % 3 pred FROM documents JOIN labels USING (doc_id)),
 cs AS (SELECT block, k class_id, count(*) FILTER (ref=k) actual, count(*) FILTER (pred=k) predicted, count(*) FILTER (ref=k AND pred=k) tp FROM (SELECT * FROM cf WHERE ref <> 255 AND block IS NOT NULL), range(3) t(k) GROUP BY ALL)
 SELECT *, round(tp/nullif(actual+predicted-tp,0), 8) iou, round(tp/nullif(predicted,0), 8) precision_, round(tp/nullif(actual,0), 8) recall, round(2*tp/nullif(actual+predicted,0), 8) f1,
  round(avg(tp/nullif(actual+predicted-tp,0)) OVER (PARTITION BY block), 8) macro_iou FROM cs""")
def block_class_scores(spark, folder):
    """Class scores of every block and of all blocks together."""
    d = confusion_rows(spark, folder).withColumn("block", F.explode(F.array(F.concat(F.col("lang"), F.lit(":"), F.col("source")), F.lit("all")))).where("block is not null")
    m = C.confusion(d, spark.range(3).select(F.col("id").cast("int").alias("class_id")), ["block"])
    out = C.class_scores(m.select("block", "ref", "pred", "n"), ["block"]).withColumnRenamed("precision", "precision_")
    return out.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("A17_unknown_fraction", """SELECT lang, round(avg(CASE WHEN doc_id % 3 = 2 THEN 1.0 ELSE 0 END), 8) unknown_fraction, count(*) n FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 GROUP BY ALL""")
def unknown_fraction(spark, folder):
    d = confusion_rows(spark, folder).where("ref <> 255")
    return d.groupBy("lang").agg(F.round(F.avg((F.col("pred") == 2).cast("double")), 8).alias("unknown_fraction"), F.count("*").alias("n"))


@query("A19_split_class_counts", B.with_ctes(B.SAMPLES, "SELECT split, count(*) FILTER (quality=0) class_0, count(*) FILTER (quality=1) class_1 FROM sm JOIN labels ON doc_id = id GROUP BY ALL"))
def split_class_counts(spark, folder):
    d = B.samples(spark, folder).join(B.table(spark, folder, "labels"), F.col("id") == F.col("doc_id"))
    out = d.groupBy("split").pivot("quality", [0, 1]).count()
    return out.select("split", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"class_{k}") for k in (0, 1)])


FIT = B.USE + """, tr AS (SELECT * FROM us WHERE split='train'), mo AS (SELECT [avg(f0),avg(f1),avg(f2),avg(f3)] mu, [stddev_pop(f0),stddev_pop(f1),stddev_pop(f2),stddev_pop(f3)] sd FROM tr),
 ce AS (SELECT use_label, count(*) n, [(avg(f0)-any_value(mu[1]))/any_value(sd[1]), (avg(f1)-any_value(mu[2]))/any_value(sd[2]), (avg(f2)-any_value(mu[3]))/any_value(sd[3]), (avg(f3)-any_value(mu[4]))/any_value(sd[4])] ct FROM tr, mo GROUP BY ALL)"""


@query("A24_centroid_fit", B.with_ctes(FIT, "SELECT use_label, n, round(ct[1], 6) c0, round(ct[2], 6) c1, round(ct[3], 6) c2, round(ct[4], 6) c3 FROM ce"))
def centroid_fit(spark, folder):
    m = L.fit(B.use_rows(spark, folder), FE)
    return m.select("use_label", "n", *[F.round(F.col("center")[i], 6).alias(f"c{i}") for i in range(4)])


@query("A24_fit_guards", B.with_ctes(B.USE + """, tr AS (SELECT * FROM us WHERE split = 'train'), k AS (SELECT use_label, count(*) n FROM tr GROUP BY ALL)""", """SELECT 'block_in_one_split' AS "check", n = 0 AS passed, n AS detail FROM (SELECT count(*) n FROM (SELECT site_id, id % 20 b FROM us GROUP BY ALL HAVING count(DISTINCT split) > 1))
 UNION ALL SELECT 'evidence', n = 0, n FROM (SELECT count(*) n FROM tr WHERE id % 19 = 0 OR use_label IS NULL OR use_label = 'unknown')
 UNION ALL SELECT 'two_classes', n = 0, n FROM (SELECT CASE WHEN count(*) < 2 THEN 1 ELSE 0 END n FROM k) UNION ALL SELECT 'two_rows_per_class', n = 0, n FROM (SELECT count(*) n FROM k WHERE n < 2)
 UNION ALL SELECT 'finite_attributes', n = 0, n FROM (SELECT count(*) n FROM tr WHERE id % 23 = 0)"""))
def fit_guards(spark, folder):
    """What speaks against fitting: blocks in two splits, unreviewed evidence, too few classes or rows, missing attributes."""
    rows = B.use_rows(spark, folder).withColumn("block_id", F.col("id") % 20).withColumn("reviewed", F.col("id") % 19 != 0).withColumn("f0", F.expr("if(id % 23 = 0, null, f0)"))
    return L.fit_guards(rows, FE)


PRED = FIT + """, zz AS (SELECT id, CASE WHEN id % 17 = 0 THEN NULL ELSE f0 END g0, f1, f2, f3 FROM us WHERE split='evaluation'),
 ds AS (SELECT id, g0, use_label, sqrt(((coalesce(g0,0)-mu[1])/sd[1]-ct[1])**2 + ((f1-mu[2])/sd[2]-ct[2])**2 + ((f2-mu[3])/sd[3]-ct[3])**2 + ((f3-mu[4])/sd[4]-ct[4])**2) d FROM zz, mo, ce),
 rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, use_label) i FROM ds), p2 AS (SELECT id, any_value(g0) g0, max(CASE WHEN i=1 THEN d END) d1, max(CASE WHEN i=2 THEN d END) d2, max(CASE WHEN i=1 THEN use_label END) l FROM rk GROUP BY id)"""


def predictions(spark, folder):
    rows = B.use_rows(spark, folder)
    ev = rows.where("split = 'evaluation'").withColumn("f0", F.expr("if(id % 17 = 0, null, f0)"))
    return L.predict(ev, L.fit(rows, FE), FE, max_distance=2.0, margin=0.1)


@query("A25_centroid_predict", B.with_ctes(PRED, """SELECT id, CASE WHEN g0 IS NULL THEN 'unknown' WHEN d1 <= 2.0 AND NOT d2-d1 < 0.1 THEN l ELSE 'unknown' END suggestion, CASE WHEN g0 IS NOT NULL THEN round(d1, 6) END distance FROM p2"""))
def centroid_predict(spark, folder):
    return predictions(spark, folder).select("id", "suggestion", F.round("distance", 6).alias("distance"))


@query("W5_two_nearest", B.with_ctes(PRED, "SELECT id, l nearest, round(d2 - d1, 6) margin FROM p2 WHERE g0 IS NOT NULL"))
def two_nearest(spark, folder):
    """Margin between the two nearest centres (a rule that never abstains shows the nearest)."""
    rows = B.use_rows(spark, folder)
    ev = rows.where("split = 'evaluation' and id % 17 <> 0")
    near = L.two_nearest(ev, L.fit(rows, FE), FE)
    return near.select("id", F.col("nearest")[0]["label"].alias("nearest"), F.round(F.col("nearest")[1]["d"] - F.col("nearest")[0]["d"], 6).alias("margin"))


@query("A36_best_epoch", """SELECT lang, arg_min(doc_id // 7, (-(n_chars % 50), doc_id // 7)) epoch, max(n_chars % 50) score FROM documents GROUP BY ALL""")
def best_epoch(spark, folder):
    d = B.table(spark, folder, "documents").selectExpr("lang", "doc_id div 7 epoch", "n_chars % 50 score")
    return L.best_epoch(d, ["lang"], "score")


@query("A26_method_decision", """WITH s AS (SELECT o_orderkey // 500 site_id, CASE WHEN o_orderkey % 3 = 0 THEN 'base' WHEN o_orderkey % 3 = 1 THEN 'x' ELSE 'y' END method_, o_orderkey % 16 // 4 w, o_custkey % 100 v, o_orderkey % 90 u FROM orders),
 p AS (SELECT site_id, method_, w, avg(v) recall, avg(u)/100 iou FROM s GROUP BY ALL UNION ALL SELECT site_id, method_, -1, avg(v), avg(u)/100 FROM s GROUP BY ALL),
 j AS (SELECT m.site_id, m.method_, m.w, m.recall > b.recall g, m.iou >= b.iou - 0.02 k FROM p m JOIN p b ON b.site_id=m.site_id AND b.w=m.w AND b.method_='base' WHERE m.method_ <> 'base')
 SELECT site_id, method_, count(*) FILTER (g AND w >= 0) windows_gained, bool_or(g AND w < 0) recall_up, bool_or(k AND w < 0) iou_kept, bool_or(g AND w < 0) AND bool_or(k AND w < 0) AND count(*) FILTER (g AND w >= 0) > 1 better FROM j GROUP BY ALL""")
def method_decision(spark, folder):
    s = B.table(spark, folder, "orders").selectExpr("o_orderkey div 500 site_id", "case o_orderkey % 3 when 0 then 'base' when 1 then 'x' else 'y' end method", "o_orderkey % 16 div 4 window_id", "o_custkey % 100 v", "o_orderkey % 90 u")
    g = s.groupingSets([["site_id", "method", "window_id"], ["site_id", "method"]], "site_id", "method", "window_id").agg(F.avg("v").alias("recall"), (F.avg("u") / 100).alias("iou"))
    return L.better_method(g, "base").withColumnRenamed("method", "method_")


@query("A37_use_suggestions", B.with_ctes(B.AREA, """SELECT site_id, feature_id, round(n*0.01, 6) area_m2, round(4*pi()*n*0.01/((2*(w+h)*0.1)**2), 6) compactness, CASE WHEN site_id % 4 = 3 THEN 'unknown' ELSE NULL END missing_road, 'unknown' functional_use FROM ar"""))
def use_suggestions(spark, folder):
    """Attributes of a building layer with a road layer, then suggestions of a fitted model."""
    fp = B.footprints(spark, folder)
    d = pin(fp, area_m2=M.area(R()), compactness=M.compactness(R()), c=M.centroid(R()), segs=M.segments(R()))
    d = d.select("site_id", "feature_id", "area_m2", "compactness", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "segs")
    road = P.nearest_line(d, roads(spark, folder), ["site_id"], "feature_id", 4.0, ("area_m2", "compactness", "x", "y"))
    rows = cut(P.neighbour_counts(road, ["site_id"], "feature_id", 3.0, ("area_m2", "compactness", "distance")))
    rows = rows.withColumn("split", F.lit("train")).withColumn("use_label", F.expr("if(area_m2 > 0.5, 'large', 'small')"))
    fe = ["area_m2", "compactness", "distance", "neighbours"]
    model = L.fit(rows.where("distance is not null"), fe)
    out = L.predict(rows, model, fe)
    return out.select("site_id", "feature_id", F.round("area_m2", 6).alias("area_m2"), F.round("compactness", 6).alias("compactness"),
                      F.when(F.col("reason") == "missing attributes", F.col("suggestion")).alias("missing_road"), F.lit("unknown").alias("functional_use"))


@query("U3_layer_union", B.with_ctes(B.FP, "SELECT split, feature_type, count(*) n FROM (SELECT 'train' split, feature_type FROM fp WHERE ok % 2 = 0 UNION ALL SELECT 'evaluation', feature_type FROM fp WHERE ok % 2 = 1) GROUP BY ALL"))
def layer_union(spark, folder):
    fp = B.boxes(spark, folder)
    a = fp.where("ok % 2 = 0").withColumn("split", F.lit("train"))
    return a.unionByName(fp.where("ok % 2 = 1").withColumn("split", F.lit("evaluation"))).groupBy("split", "feature_type").agg(F.count("*").alias("n"))


@query("S18_prepared_tiles", B.with_ctes(B.RASTER, """, t AS (SELECT site_id, r//8 tr, c//8 tc, count(*) FILTER (pk % 3 <> 0)/64 valid, count(*) n FROM raster GROUP BY ALL),
 k AS (SELECT *, CASE WHEN tc < 3 THEN 'train' WHEN tc < 5 THEN 'development' ELSE 'evaluation' END split FROM t WHERE tr % 2 = 0 AND tc <> 3 AND (tr*8+tc) % 5 <> 4 AND valid >= 0.5)
 SELECT k.split, total % 4 class_id, count(*) cells, count(DISTINCT (k.site_id, k.tr, k.tc)) tiles FROM k JOIN raster ON raster.site_id=k.site_id AND r//8=k.tr AND c//8=k.tc WHERE pk % 3 <> 0 AND r % 2 = 1 AND c % 2 = 1 GROUP BY ALL"""))
def prepared_tiles(spark, folder):
    """Declared rows and column bands, audited tiles only, at least half valid, classes per split."""
    from gridfold.operators.tiles import nearest
    r = B.raster(spark, folder).withColumn("tr", F.expr("row div 8")).withColumn("tc", F.expr("col div 8")).withColumn("valid", F.col("pk") % 3 != 0)
    declared = (r.select("site_id").distinct().withColumn("tr", F.explode(F.array(*map(F.lit, (0, 2, 4, 6))))).withColumn("tc", F.explode(F.array(*map(F.lit, (0, 1, 2, 4, 5, 6, 7)))))
                .withColumn("split", F.expr("case when tc < 3 then 'train' when tc < 5 then 'development' else 'evaluation' end")))
    audited = r.select("site_id", "tr", "tc").distinct().where("(tr * 8 + tc) % 5 <> 4")
    share = r.groupBy("site_id", "tr", "tc").agg((F.count_if("valid") / 64).alias("share")).where("share >= 0.5")
    tiles = declared.join(audited, ["site_id", "tr", "tc"]).join(share, ["site_id", "tr", "tc"])
    lab = nearest(r.where("valid"), 2).join(tiles, ["site_id", "tr", "tc"])
    return lab.groupBy("split", (F.col("total") % 4).alias("class_id")).agg(F.count("*").alias("cells"), F.count_distinct("site_id", "tr", "tc").alias("tiles"))
