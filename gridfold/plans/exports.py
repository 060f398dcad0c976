"""Source, sink, gate and scalar queries with SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.functions import measures as M
from gridfold.functions import projection as G
from gridfold.operators import export as E
from gridfold.operators import review as V
from gridfold.plans import bindings as B
from gridfold.plans.registry import query
from gridfold.plans.review import SF, SNAP, base, log, snap_cte
from gridfold.plans.scoring import SCORES
from gridfold.plans.topology import R, UV
from gridfold.session import pin, scratch
from gridfold.sources import documents as D
from gridfold.sources import features as X
from gridfold.sources import rasters as W  # noqa: F401
from gridfold.sources import sinks as Z


def described(spark, folder):
    """Footprints with provenance columns; a few rows break the rules on purpose."""
    bx = B.boxes(spark, folder)
    d = bx.selectExpr("*", "case when ok % 101 = 5 then 'robot' else element_at(array('ai_copy','human_edited','human_drawn'), cast(ok % 3 + 1 as int)) end origin",
                      "case when ok % 103 = 5 then 'done' else element_at(array('suggested','accepted','rejected'), cast(ok % 3 + 1 as int)) end review_status",
                      "case when ok % 4 = 0 then 'land_cover' else 'building_footprint' end kind", "if(ok % 8 = 0, null, 'roof') class_name", "concat('layer-', ok % 3) source_layer")
    return B._rings(d)


def collections(spark, folder):
    """GeoJSON FeatureCollections of at most 500 features each, written by Spark."""
    path = scratch(spark, "geojson")
    f = B.footprints(spark, folder).withColumn("block", F.expr("feature_id div 500"))
    g = X.geojson(R(), F.struct(F.col("feature_id").alias("source_id"), "feature_type"), F.col("feature_id"))
    docs = f.groupBy("site_id", "block").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(g), ","), F.lit("]}")).alias("value"))
    docs.write.partitionBy("site_id", "block").text(path)
    return path


@query("S1_read_geojson", B.with_ctes(B.AREA, "SELECT 'ai:' || feature_id feature_id, feature_type, round(n*0.01, 6) area_m2 FROM ar"))
def read_geojson(spark, folder):
    path = collections(spark, folder)
    doc = spark.read.text(path, wholetext=True).select("value")
    rows = X._rows(doc.select(F.explode(F.from_json("value", f"struct<type:string,features:array<{X.FEATURE}>>")["features"]).alias("f")))
    return rows.select(F.concat(F.lit("ai:"), F.col("properties")["source_id"]).alias("feature_id"), F.col("properties")["feature_type"].alias("feature_type"),
                       F.round(M.area(F.col("rings")), 6).alias("area_m2"))


LL = "(feature_id % 36000)/100.0 - 180 + 0.005"


@query("S2_quadkey_footprints", B.with_ctes(B.FP, """SELECT feature_id, count(*) OVER () hits FROM (SELECT feature_id, (ok % 400)/100.0 - 70 lon, (ok * 7 % 300)/100.0 - 18 lat, w, h FROM fp)
  WHERE lon + w/1000.0 >= -69 AND lon <= -68 AND lat + h/1000.0 >= -17 AND lat <= -16"""))
def quadkey_footprints(spark, folder):
    """Gzipped GeoJSON lines in quadkey folders; the quadkeys of the area prune the folders."""
    path = scratch(spark, "quadkeys")
    d = B.boxes(spark, folder).selectExpr("feature_id", "(ok % 400) / 100D - 70 lon", "(ok * 7 % 300) / 100D - 18 lat", "w / 1000D dw", "h / 1000D dh")
    d = d.withColumn("rings", F.array(M.box_ring(F.col("lon"), F.col("lat"), F.col("lon") + F.col("dw"), F.col("lat") + F.col("dh"))))
    d = d.withColumn("quadkey", G.quadkey(F.col("lon"), F.col("lat"), 5))
    d.select("quadkey", X.geojson(F.col("rings"), F.struct("feature_id"), F.col("feature_id")).alias("value")).write.partitionBy("quadkey").option("compression", "gzip").text(path)
    # boxes lie in the folder of their south-west corner, so the area reaches out by the largest box
    reach = d.agg(F.max("dw").alias("w"), F.max("dh").alias("h")).first()
    wanted = G.area_quadkeys(spark, -69 - (reach["w"] or 0), -17 - (reach["h"] or 0), -68, -16, 5)
    lines = X.read_lines(spark, path)
    got = lines.join(wanted.select(F.col("quadkey").cast(lines.schema["quadkey"].dataType)), "quadkey", "left_semi")
    got = X.bbox_query(X.with_bbox(got.select(F.col("properties")["feature_id"].cast("long").alias("feature_id"), "rings", "file")), -69.0, -17.0, -68.0, -16.0)
    n = got.agg(F.count("*").alias("hits")).withColumn("_j", F.lit(1))
    return got.select("feature_id", F.lit(1).alias("_j")).join(F.broadcast(n), "_j").drop("_j")


@query("S3_draft_polygons", B.with_ctes(B.LABELS, """SELECT site_id || '-' || window_id AS win, format('{}-{}-D-{:02d}', site_id, window_id, row_number() OVER (PARTITION BY site_id, window_id ORDER BY label_id)) label_id, confidence, ign AS ignored, round(CASE WHEN lshape THEN w*h - (w - w//2)*(h - h//2) ELSE w*h END*0.01, 6) area_m2 FROM lab"""))
def draft_polygons(spark, folder):
    path = scratch(spark, "drafts")
    lb = B.labels(spark, folder)
    m = B.boxes(spark, folder).where("ok % 3 <> 0 and not is_copy").selectExpr("feature_id label_id", "w", "h", "x0", "y0", "lshape")
    d = lb.join(m, "label_id").withColumn("win", F.concat_ws("-", "site_id", "window_id"))
    poly = F.expr("""if(lshape, array(array(x0, y0), array(x0 + w, y0), array(x0 + w, y0 + h div 2), array(x0 + w div 2, y0 + h div 2), array(x0 + w div 2, y0 + h), array(x0, y0 + h)),
        array(array(x0, y0), array(x0 + w, y0), array(x0 + w, y0 + h), array(x0, y0 + h)))""")
    item = F.struct("label_id", F.struct(poly.alias("poly"), "confidence", F.lit("drawn").alias("note"), "ignore").alias("p"))
    docs = d.groupBy("win").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.p).alias("polys"))
    docs.select("win", F.to_json(F.struct(F.lit("2026-01-01").alias("created"), F.create_map("win", "polys").alias("windows"))).alias("value")).write.partitionBy("win").text(path)
    wins = docs.select(F.col("win").alias("window"), F.lit(0.0).alias("left"), F.lit(100.0).alias("top"), F.lit(0.1).alias("res"))
    out = D.read_drafts(spark, path, wins, "D")
    return out.select(F.col("window").alias("win"), "label_id", "confidence", F.col("ignore").alias("ignored"), F.round(M.area(F.col("rings")), 6).alias("area_m2"))


@query("S4_review_decisions", B.with_ctes(B.LABELS, """SELECT kind, value, count(*) n FROM (SELECT 'decision' kind, CASE label_id % 4 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'edit' ELSE 'confirm' END AS value FROM lab
  UNION ALL SELECT 'edit', 'moved' FROM lab WHERE label_id % 4 = 1 UNION ALL SELECT DISTINCT 'added_ignore_region', 'r' || (site_id % 3) || window_id FROM lab WHERE false) GROUP BY ALL
  UNION ALL SELECT 'added_ignore_region', 'shade', count(*) FROM (SELECT DISTINCT site_id, window_id FROM lab)"""))
def review_decisions(spark, folder):
    path = scratch(spark, "decisions")
    d = B.labels(spark, folder).withColumn("win", F.concat_ws("-", "site_id", "window_id")).withColumn("item", F.col("label_id").cast("string")).withColumn(
        "v", F.expr("case label_id % 4 when 0 then 'uncertain' when 1 then 'edit' else 'confirm' end"))
    box = F.expr("array(array(0, 0), array(4, 0), array(4, 4))")
    docs = d.groupBy("win").agg(F.map_from_entries(F.collect_list(F.struct("item", "v"))).alias("decisions"), F.map_from_entries(F.collect_list(F.when(F.col("v") == "edit", F.struct("item", F.struct(box.alias("poly"), F.lit("moved").alias("reason")))))).alias("edits"))
    body = F.struct("decisions", "edits", F.array(F.struct(box.alias("poly"), F.lit("shade").alias("note"))).alias("added_ignore_regions"))
    docs.select("win", F.to_json(F.struct(F.lit("r1").alias("reviewer"), F.lit("2026-01-02").alias("review_date"), F.create_map("win", body).alias("windows"))).alias("value")).write.partitionBy("win").text(path)
    return D.read_decisions(spark, path).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("S5_cut_decisions", "SELECT CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'uncertain' END status, count(*) n, count(*) FILTER (doc_id % 5 = 0) with_reason FROM documents GROUP BY ALL")
def cut_decisions(spark, folder):
    """Decisions written (S12) and read as CSV with an explicit schema."""
    path = scratch(spark, "cuts")
    Z.write_log(B.table(spark, folder, "documents").selectExpr("concat('C', doc_id) cut_id", "case doc_id % 3 when 0 then 'accepted' when 1 then 'rejected' else 'uncertain' end proposed_status", "if(doc_id % 5 = 0, 'colour, and \"edge\"', null) reason"), path)
    d = D.read_cut_decisions(spark, path)
    return d.groupBy(F.col("proposed_status").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("reason") == 'colour, and "edge"').alias("with_reason"))


@query("S6_score_table", B.with_ctes(SCORES, """SELECT site_id, coalesce(CAST(window_id AS VARCHAR), 'overall') win, unnest(['tp','fp','matched']) metric, CAST(unnest([tp, fp, matched]) AS DOUBLE) AS value FROM sc""", True))
def score_table(spark, folder):
    from gridfold.operators import scoring as C
    from gridfold.plans.scoring import MIN_CELLS, inputs
    rep = Z.score_report(C.score(*inputs(spark, folder), MIN_CELLS))
    return D.score_table(rep, ["tp", "fp", "matched"]).withColumnRenamed("window", "win")


@query("S7_site_manifests", "SELECT CAST(doc_id % 97 AS VARCHAR) site_id, count(*) files, count(*) > 1 AS duplicate FROM documents GROUP BY ALL")
def site_manifests(spark, folder):
    return manifests_of(spark, B.table(spark, folder, "documents"))


def manifests_of(spark, docs):
    """A manifest for each document, as lines below one folder a site (at most eight files each), and read back."""
    path = scratch(spark, "manifests")
    lines = docs.selectExpr("doc_id % 97 site", "pmod(doc_id, 8) part", "to_json(named_struct('site_id', cast(doc_id % 97 as string), 'name', lang, 'file', concat('manifest-', doc_id, '.json'))) value")
    lines.repartition("site", "part").select("site", "value").write.partitionBy("site").text(path)
    m = D.site_manifests(spark, path)
    return m.select("site_id", "files", "duplicate").distinct()


GOOD = "NOT (ok % 101 = 5 OR ok % 103 = 5 OR (ok % 4 = 0 AND ok % 8 = 0))"


def export_rows(spark, folder):
    d = described(spark, folder)
    d = d.withColumn("error", E.provenance_error(F.col("origin"), F.col("review_status"), F.col("kind"), F.col("class_name")))
    return d


@query("P14_provenance_gate", B.with_ctes(B.FP, """SELECT feature_id, CASE WHEN ok % 101 = 5 THEN 'invalid_origin' WHEN ok % 103 = 5 THEN 'invalid_status' ELSE 'class_required' END error FROM fp WHERE ok % 101 = 5 OR ok % 103 = 5 OR (ok % 4 = 0 AND ok % 8 = 0)"""))
def provenance_gate(spark, folder):
    return export_rows(spark, folder).where("error is not null").select("feature_id", "error")


@query("P27_class_required", B.with_ctes(B.FP, "SELECT site_id, count(*) rejected FROM fp WHERE ok % 8 = 0 AND ok % 101 <> 5 AND ok % 103 <> 5 GROUP BY ALL"))
def class_required(spark, folder):
    return export_rows(spark, folder).where("error = 'class_required'").groupBy("site_id").agg(F.count("*").alias("rejected"))


@query("L4_first_errors", B.with_ctes(B.FP, f"SELECT feature_id FROM fp WHERE NOT {GOOD} ORDER BY feature_id LIMIT 50"))
def first_errors(spark, folder):
    return E.first_errors(export_rows(spark, folder), "feature_id").select("feature_id")


@query("P15_output_gate", B.with_ctes(B.FP, """SELECT site_id, coalesce(error, 'ok') error, count(*) n FROM (SELECT site_id, CASE WHEN ok % 37 = 1 OR ok % 41 IN (1, 2) AND ok // 41 % 50 = 3 OR ok % 97 = 0 THEN 'source_id' WHEN ok % 43 = 1 THEN 'feature_type' WHEN ok % 47 = 1 THEN 'functional_use' END error
  FROM fp) GROUP BY ALL"""))
def output_gate(spark, folder):
    d = B.boxes(spark, folder).selectExpr(
        "site_id", "case when ok % 41 in (1, 2) and ok div 41 % 50 = 3 then 5000000000 + ok div 41 when ok % 37 = 1 then 0L else ok + 1 end source_id",
        "if(ok % 43 = 1, 'tree', 'road_surface') feature_type", "if(ok % 47 = 1, 'shop', null) functional_use")
    return E.output_errors(d, ["site_id"]).groupBy("site_id", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("S15_import_candidates", B.with_ctes(B.FP, "SELECT site_id, CAST(feature_id AS VARCHAR) import_source_id, row_number() OVER (PARTITION BY site_id ORDER BY feature_id) source_id, 'unknown' functional_use, CASE WHEN ok % 3 = 0 THEN round((ok % 100)/100.0, 6) END score FROM fp"))
def import_candidates(spark, folder):
    d = B.boxes(spark, folder).selectExpr("site_id", "feature_id", "if(ok % 3 = 0, (ok % 100) / 100D, null) score")
    return E.import_candidates(d, ["site_id"], "feature_id").select("site_id", "import_source_id", "source_id", "functional_use", F.round("score", 6).alias("score"))


@query("A22_export_manifest", B.with_ctes(B.AREA, f""", d AS (SELECT site_id, n, ['ai_copy','human_edited','human_drawn'][ok%3+1] origin, ['suggested','accepted','rejected'][ok%3+1] review_status, CASE WHEN ok%4=0 THEN 'land_cover' ELSE 'building_footprint' END feature_type, 'layer-' || (ok%3) source_layer FROM ar WHERE {GOOD})
 SELECT site_id, 'all' "by", 'all' AS value, count(*) features, round(sum(n)*0.01, 3) area_m2 FROM d GROUP BY site_id UNION ALL SELECT site_id, 'origin', origin, count(*), round(sum(n)*0.01, 3) FROM d GROUP BY ALL
 UNION ALL SELECT site_id, 'review_status', review_status, count(*), round(sum(n)*0.01, 3) FROM d GROUP BY ALL UNION ALL SELECT site_id, 'feature_type', feature_type, count(*), round(sum(n)*0.01, 3) FROM d GROUP BY ALL UNION ALL SELECT site_id, 'source_layer', source_layer, count(*), round(sum(n)*0.01, 3) FROM d GROUP BY ALL"""))
def export_manifest(spark, folder):
    d = export_rows(spark, folder).where("error is null").drop("feature_type").withColumnRenamed("kind", "feature_type")
    d = pin(d, area_mm2=F.round(M.area(R()) * 1e6).cast("long"))
    return E.manifest(d.drop("rings"), ["site_id"])


@query("S10_export_features", B.with_ctes(B.AREA, f"SELECT CASE WHEN ok%4=0 THEN 'land_cover' ELSE 'building_footprint' END feature_type, count(*) features, round(sum(n)*0.01, 2) area_m2, count(*) in_wgs84 FROM ar WHERE {GOOD} GROUP BY ALL UNION ALL SELECT 'refused', count(*), 0, 0 FROM ar WHERE NOT ({GOOD})"))
def export_features(spark, folder):
    """Refused whole while a row is bad; the good rows are then written in both CRSs, one folder
    per class with the manifest beside them, and read back."""
    path, none = scratch(spark, "export"), scratch(spark, "refused")
    rows = export_rows(spark, folder).drop("feature_type").withColumnRenamed("kind", "feature_type")
    moved = F.transform(R(), lambda r: F.transform(r, lambda p: F.struct((p.x + 600800).alias("x"), (p.y + 8171000).alias("y"))))
    rows = rows.withColumn("rings", moved)
    listed = E.manifest(pin(rows.where("error is null"), area_mm2=F.round(M.area(R()) * 1e6).cast("long")).drop("rings"), ["site_id"])
    ready = rows.select("feature_id", "feature_type", "origin", "review_status", "rings", "error")
    refused = Z.export_all_or_nothing(ready, listed, none, 19, True).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("features"))
    Z.export_all_or_nothing(ready.where("error is null"), listed, path, 19, True)
    a = X.read_lines(spark, f"{path}/analysis").groupBy("feature_type").agg(F.count("*").alias("features"), F.round(F.sum(F.round(M.area(R()) * 100).cast("long")) * 0.01, 2).alias("area_m2"))
    w = pin(X.read_lines(spark, f"{path}/wgs84"), b=M.bounds(R())).where("b.xmin > -69 and b.xmax < -68 and b.ymin > -17 and b.ymax < -16")
    good = a.join(w.groupBy("feature_type").agg(F.count("*").alias("in_wgs84")), "feature_type")
    zero = F.lit(0).cast("long")
    return good.unionByName(refused.select(F.lit("refused").alias("feature_type"), "features", F.lit(0.0).alias("area_m2"), zero.alias("in_wgs84")))


@query("S11_parcel_export", B.with_ctes(SNAP + ", " + snap_cte("s", 30), """SELECT kind, count(*) entities FROM (SELECT CASE feature % 4 WHEN 0 THEN 'survey_observation' WHEN 1 THEN 'boundary_segment' ELSE 'parcel' END kind, status FROM s) WHERE kind <> 'parcel' OR status IN ('accepted', 'suggested') GROUP BY ALL
  UNION ALL SELECT 'history', count(*) FROM ev WHERE revision <= 30"""))
def parcel_export(spark, folder):
    path = scratch(spark, "parcels")
    lg = log(spark, folder)
    snap = V.snapshot(lg, 30, SF, base(spark, folder)).select(*SF, F.col("after.status").alias("parcel_state"), "after.k",
                                                            F.expr("case feature % 4 when 0 then 'survey_observation' when 1 then 'boundary_segment' else 'parcel' end").alias("kind"))
    Z.export_parcels(snap, lg.where("revision <= 30").select("site_id", "revision", "operation", "feature"), path, ["accepted", "suggested"])
    a = spark.read.parquet(f"{path}/entities").groupBy("kind").agg(F.count("*").alias("entities"))
    h = spark.read.schema("site_id long, revision long").json(f"{path}/history").agg(F.count("*").alias("entities")).select(F.lit("history").alias("kind"), "entities")
    return a.unionByName(h)


@query("S12_log_csv", "SELECT event_type, count(*) n, CAST(sum(event_id) AS BIGINT) ids FROM events GROUP BY ALL")
def log_csv(spark, folder):
    path = scratch(spark, "log")
    Z.write_log(B.table(spark, folder, "events").select("event_id", "event_type", "props"), path)
    d = spark.read.csv(path, header=True, schema="event_id long, event_type string, props string", enforceSchema=False)
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("S13_class_map", B.with_ctes(B.RASTER, "SELECT site_id, total % 4 class_id, count(*) cells FROM raster GROUP BY ALL"))
def class_map(spark, folder):
    path = W.write_tiles(B.raster(spark, folder).withColumn("class_id", F.col("total") % 4), ["site_id"], 32, ["class_id"])
    return W.read_tiles(spark, path, 32).groupBy("site_id", "class_id").agg(F.count("*").alias("cells"))


@query("F2_geometry_hash", B.with_ctes(B.FP, """SELECT feature_id, sha256(CASE WHEN lshape
   THEN concat_ws(' ', x0 || ',' || y0, x0+w || ',' || y0, x0+w || ',' || y0+h//2, x0+w//2 || ',' || y0+h//2, x0+w//2 || ',' || y0+h, x0 || ',' || y0+h)
   ELSE concat_ws(' ', x0 || ',' || y0, x0+w || ',' || y0, x0+w || ',' || y0+h, x0 || ',' || y0+h) END) geometry_sha256 FROM fp"""))
def geometry_hash(spark, folder):
    """Hash of the canonical vertex string in cells, for rings given in any direction and from any start."""
    turned = F.transform(R(), lambda r: F.when(F.col("feature_id") % 2 == 0, F.reverse(r)).otherwise(F.concat(F.slice(r, 3, F.size(r) - 2), F.slice(r, 2, 2))))
    d = pin(B.footprints(spark, folder), t=M.canonical_text(turned, B.RES))
    return d.select("feature_id", F.sha2("t", 256).alias("geometry_sha256"))


@query("F3_safe_division", "SELECT doc_id, round(n_chars / nullif(doc_id % 5, 0), 6) ratio FROM documents")
def safe_division(spark, folder):
    from gridfold.operators.scoring import ratio
    return B.table(spark, folder, "documents").select("doc_id", F.round(ratio(F.col("n_chars"), F.col("doc_id") % 5), 6).alias("ratio"))


@query("F4_rounding", "SELECT event_id, round((value + 0.013) / 7, 1) r1, round((value + 0.013) / 7, 3) r3, round((value + 0.013) / 7, 4) r4 FROM events")
def rounding(spark, folder):
    v = (F.col("value") + 0.013) / 7
    return B.table(spark, folder, "events").select("event_id", *[F.round(v, k).alias(f"r{k}") for k in (1, 3, 4)])


@query("F5_flag_lists", "SELECT doc_id, len(list_filter(string_split(CASE WHEN doc_id % 2 = 0 THEN lang || ',,' || source ELSE '' END, ','), lambda x: x <> '')) flags FROM documents")
def flag_lists(spark, folder):
    raw = F.expr("if(doc_id % 2 = 0, concat(lang, ',,', source), '')")
    return B.table(spark, folder, "documents").select("doc_id", F.size(F.filter(F.split(raw, ","), lambda f: f != "")).cast("long").alias("flags"))


@query("F7_nested_to_json", """SELECT doc_id, '{"lang":"' || lang || '","n":' || n_chars || '}' props FROM documents""")
def nested_to_json(spark, folder):
    return B.table(spark, folder, "documents").select("doc_id", F.to_json(F.struct("lang", F.col("n_chars").alias("n"))).alias("props"))


@query("F8_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') stamp, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events")
def timestamps(spark, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.date_format(F.to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
    return B.table(spark, folder, "events").select("event_id", stamp.alias("stamp"), day.alias("day"))
