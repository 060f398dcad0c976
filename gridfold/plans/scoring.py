"""Scoring queries and their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.operators import pairs as P
from gridfold.operators import scoring as C
from gridfold.operators import spans as S
from gridfold.plans import bindings as B
from gridfold.plans.registry import query
from gridfold.session import cut, dealt

MIN_CELLS = 10  # smallest scored piece in the derived layers (they are small buildings)


def inputs(spark, folder):
    preds = B.covered(B.footprints(spark, folder), "feature_id").select("site_id", "id", "spans", "cells")
    labels = B.covered(B.labels(spark, folder), "label_id").select("site_id", "id", "window_id", "ignore", "confidence", "spans", "cells")
    return preds, labels, B.windows(spark, folder)


WIN = B.LABELS + f""",
win AS (SELECT DISTINCT site_id, wr*4+wc window_id, wr*{B.WINDOW} r0, (wr+1)*{B.WINDOW} r1, wc*{B.WINDOW} k0, (wc+1)*{B.WINDOW} k1
  FROM fp, range(4) a(wr), range(4) b(wc)),
cells AS (SELECT site_id, feature_id, y0 + dy AS r, x0 + dx AS c
  FROM fp, range(w) a(dx), range(h) b(dy) WHERE NOT (lshape AND dx >= w // 2 AND dy >= h // 2)),
lc AS (SELECT l.*, count(*) OVER (PARTITION BY label_id) n FROM labc l JOIN win v ON l.site_id = v.site_id AND l.window_id = v.window_id
  AND r >= r0 AND r < r1 AND c >= k0 AND c < k1),
tc AS (SELECT * FROM lc WHERE NOT ign AND n >= {MIN_CELLS}),
ic AS (SELECT DISTINCT site_id, window_id, r, c FROM lc WHERE ign),
pc0 AS (SELECT v.site_id, v.window_id, p.feature_id, r, c, count(*) OVER (PARTITION BY v.site_id, v.window_id, feature_id) n
  FROM cells p JOIN win v ON p.site_id = v.site_id AND p.r >= r0 AND p.r < r1 AND p.c >= k0 AND p.c < k1),
ig AS (SELECT p.site_id, p.window_id, feature_id, count(*) k FROM pc0 p JOIN ic USING (site_id, window_id, r, c) GROUP BY ALL),
pc AS (SELECT p.* FROM pc0 p LEFT JOIN ig USING (site_id, window_id, feature_id) WHERE n >= {MIN_CELLS} AND coalesce(k,0)*2 <= n),
px AS (SELECT site_id, window_id, CAST(sum(CASE WHEN l AND p THEN 1 ELSE 0 END) AS BIGINT) tp,
   CAST(sum(CASE WHEN p AND NOT l THEN 1 ELSE 0 END) AS BIGINT) fp, CAST(sum(CASE WHEN l AND NOT p THEN 1 ELSE 0 END) AS BIGINT) fn
  FROM (SELECT site_id, window_id, r, c, bool_or(k='l') l, bool_or(k='p') p FROM
     (SELECT site_id, window_id, r, c, 'l' k FROM tc UNION ALL SELECT site_id, window_id, r, c, 'p' FROM pc)
     GROUP BY ALL) q ANTI JOIN ic USING (site_id, window_id, r, c) GROUP BY ALL),
pxw AS (SELECT w.site_id, w.window_id, coalesce(tp,0) tp, coalesce(fp,0) fp, coalesce(fn,0) fn,
   {B.WINDOW * B.WINDOW} - coalesce(ni,0) eval_px FROM win w LEFT JOIN px USING (site_id, window_id)
   LEFT JOIN (SELECT site_id, window_id, count(*) ni FROM ic GROUP BY ALL) USING (site_id, window_id)),
ov AS (SELECT p.site_id, p.window_id, p.feature_id pred, t.label_id label, any_value(p.n) pn, any_value(t.n) tn, count(*) inter
  FROM pc p JOIN tc t USING (site_id, window_id, r, c) GROUP BY ALL),
cand AS (SELECT *, inter / (pn + tn - inter) iou FROM ov WHERE inter / (pn + tn - inter) >= 0.5)"""
# sequential greedy scan over sorted candidates with the used ids kept in lists
GREEDY = WIN + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY site_id, window_id ORDER BY iou DESC, pred DESC, label DESC) i FROM cand),
scan AS (SELECT site_id, window_id, i, pred, label, iou, true ok, [pred] up, [label] ul FROM ord WHERE i = 1
  UNION ALL SELECT o.site_id, o.window_id, o.i, o.pred, o.label, o.iou,
   NOT list_contains(s.up, o.pred) AND NOT list_contains(s.ul, o.label),
   CASE WHEN NOT list_contains(s.up, o.pred) AND NOT list_contains(s.ul, o.label) THEN list_append(s.up, o.pred) ELSE s.up END,
   CASE WHEN NOT list_contains(s.up, o.pred) AND NOT list_contains(s.ul, o.label) THEN list_append(s.ul, o.label) ELSE s.ul END
  FROM scan s JOIN ord o ON o.site_id = s.site_id AND o.window_id = s.window_id AND o.i = s.i + 1),
mt AS (SELECT site_id, window_id, pred, label, iou FROM scan WHERE ok)"""
SCORES = GREEDY + """,
ob AS (SELECT w.site_id, w.window_id, coalesce(matched,0) matched, coalesce(n_pred,0) n_pred, coalesce(n_label,0) n_label, iou_sum
  FROM win w LEFT JOIN (SELECT site_id, window_id, count(*) matched, sum(iou) iou_sum FROM mt GROUP BY ALL) USING (site_id, window_id)
  LEFT JOIN (SELECT site_id, window_id, count(DISTINCT feature_id) n_pred FROM pc GROUP BY ALL) USING (site_id, window_id)
  LEFT JOIN (SELECT site_id, window_id, count(DISTINCT label_id) n_label FROM tc GROUP BY ALL) USING (site_id, window_id)),
sc AS (SELECT site_id, window_id, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn, CAST(sum(eval_px) AS BIGINT) eval_px,
  CAST(sum(matched) AS BIGINT) matched, CAST(sum(n_pred) AS BIGINT) n_pred, CAST(sum(n_label) AS BIGINT) n_label, sum(iou_sum) s
  FROM pxw JOIN ob USING (site_id, window_id) GROUP BY GROUPING SETS ((site_id, window_id), (site_id)))"""


@query("J25_row_coverage", B.with_ctes(B.CELLS, """SELECT site_id, r AS "row", count(*) cells, count(DISTINCT feature_id) features
  FROM cells GROUP BY ALL"""))
def row_coverage(spark, folder):
    sp = S.explode_spans(B.covered(B.footprints(spark, folder), "feature_id"), "site_id", "id")
    return sp.groupBy("site_id", "row").agg(F.sum(S.span_cells()).alias("cells"), F.countDistinct("id").alias("features"))


@query("J2_intersections", B.with_ctes(WIN, """SELECT a.site_id, feature_id, label_id, count(*) inter FROM cells a
  JOIN labc b USING (site_id, r, c) GROUP BY ALL"""))
def intersections(spark, folder):
    preds, labels, _ = inputs(spark, folder)
    return P.overlap_pairs(preds, labels, ["site_id"]).select("site_id", F.col("a").alias("feature_id"), F.col("b").alias("label_id"), "inter")


@query("A1_pixel_counts", B.with_ctes(WIN, "SELECT * FROM pxw"))
def pixel_counts(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, ignore, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    return C.pixel_counts(truth, pieces, ignore, win)


@query("P18_clip_to_windows", B.with_ctes(WIN, """SELECT site_id, window_id, feature_id, count(*) cells FROM pc0
  WHERE n >= 10 GROUP BY ALL"""))
def clipped(spark, folder):
    preds, _, win = inputs(spark, folder)
    return C.clip_to_windows(preds, win, MIN_CELLS).select("site_id", "window_id", F.col("id").alias("feature_id"), "cells")


@query("P19_drop_ignored", B.with_ctes(WIN, "SELECT site_id, window_id, feature_id, count(*) cells FROM pc GROUP BY ALL"))
def kept_after_ignore(spark, folder):
    preds, labels, win = inputs(spark, folder)
    return C.prepare(preds, labels, win, MIN_CELLS)[2].select("site_id", "window_id", F.col("id").alias("feature_id"), "cells")


@query("A5_greedy_matches", B.with_ctes(GREEDY, "SELECT site_id, window_id, pred, label, round(iou, 6) iou FROM mt", True))
def matches(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    m = C.greedy_match(C.candidate_matches(truth, pieces))
    return m.select("site_id", "window_id", F.col("pred.id").alias("pred"), F.col("label.id").alias("label"), F.round("iou", 6).alias("iou"))


@query("A4_window_scores", B.with_ctes(SCORES, """SELECT site_id, coalesce(window_id, -1) window_id, tp, fp, fn, eval_px, matched, n_pred, n_label,
  round(tp / nullif(tp+fp,0), 6) pixel_precision, round(tp / nullif(tp+fn,0), 6) pixel_recall, round(tp / nullif(tp+fp+fn,0), 6) pixel_iou,
  round(matched / nullif(n_pred,0), 6) building_precision, round(matched / nullif(n_label,0), 6) building_recall,
  round(s / nullif(matched,0), 6) mean_matched_iou FROM sc""", True))
def window_scores(spark, folder):
    out = C.score(*inputs(spark, folder), MIN_CELLS).withColumn("window_id", F.coalesce("window_id", F.lit(-1)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# per component all sets of used labels, with the best (pairs, sum) each: one prediction a step
OPTIMAL = WIN + """, el AS (SELECT site_id, window_id, pred, label, inter / (pn + tn - inter) iou FROM ov WHERE inter / (pn + tn - inter) >= 0.5),
 pp AS (SELECT DISTINCT a.site_id, a.window_id, a.pred u, b.pred v FROM el a JOIN el b USING (site_id, window_id, label)),
 pr AS (SELECT site_id, window_id, u, v FROM pp UNION SELECT r.site_id, r.window_id, r.u, p.v FROM pr r JOIN pp p ON p.site_id=r.site_id AND p.window_id=r.window_id AND p.u=r.v),
 pk AS (SELECT site_id, window_id, u pred, min(v) root, row_number() OVER (PARTITION BY site_id, window_id, min(v) ORDER BY u) k FROM pr GROUP BY site_id, window_id, u),
 ek AS (SELECT site_id, window_id, root, k, label, iou FROM el JOIN pk USING (site_id, window_id, pred) UNION ALL SELECT site_id, window_id, root, k, NULL, 0 FROM pk),
 dp AS (SELECT DISTINCT site_id, window_id, root, CAST(0 AS BIGINT) k, CAST([] AS BIGINT[]) used, {'n': CAST(0 AS BIGINT), 's': CAST(0 AS DOUBLE)} best FROM pk
   UNION ALL SELECT d.site_id, d.window_id, d.root, d.k + 1, CASE WHEN e.label IS NULL THEN d.used ELSE list_sort(list_append(d.used, e.label)) END,
     max({'n': CAST(d.best.n + (e.label IS NOT NULL)::BIGINT AS BIGINT), 's': CAST(d.best.s + e.iou AS DOUBLE)}) FROM dp d JOIN ek e ON e.site_id=d.site_id AND e.window_id=d.window_id AND e.root=d.root AND e.k = d.k + 1 AND (e.label IS NULL OR NOT list_contains(d.used, e.label)) GROUP BY ALL),
 db AS (SELECT site_id, window_id, root, max(best) b FROM (SELECT *, max(k) OVER (PARTITION BY site_id, window_id, root) last FROM dp) WHERE k = last GROUP BY ALL),
 ca AS (SELECT site_id, window_id, pred, count(*) n FROM el GROUP BY ALL), cb AS (SELECT site_id, window_id, label, count(*) n FROM el GROUP BY ALL)"""


@query("A6_optimal_matches", B.with_ctes(OPTIMAL, """SELECT * FROM (SELECT site_id, window_id, CAST(sum(b.n) AS BIGINT) tp, round(sum(b.s), 6) iou_sum FROM db GROUP BY ALL)
   JOIN (SELECT site_id, window_id, count(*) FILTER (n > 1) merge_candidates FROM ca GROUP BY ALL) USING (site_id, window_id) JOIN (SELECT site_id, window_id, count(*) FILTER (n > 1) split_candidates FROM cb GROUP BY ALL) USING (site_id, window_id)""", True))
def optimal_matches(spark, folder):
    """Optimal one-to-one matches and contention counts."""
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    pairs = cut(C.candidate_matches(truth, pieces))
    m = C.optimal_match(pairs).groupBy(*C.WKEYS).agg(F.count("*").alias("tp"), F.round(F.sum("iou"), 6).alias("iou_sum"))
    return m.join(C.contention(pairs), C.WKEYS)


@query("A6_candidates", B.with_ctes(WIN, """, el AS (SELECT * FROM ov WHERE inter / (pn + tn - inter) >= 0.5), a AS (SELECT site_id, window_id, pred, count(*) n FROM el GROUP BY ALL), b AS (SELECT site_id, window_id, label, count(*) n FROM el GROUP BY ALL)
  SELECT site_id, window_id, merge_candidates, split_candidates FROM (SELECT site_id, window_id, count(*) FILTER (n > 1) merge_candidates FROM a GROUP BY ALL) JOIN (SELECT site_id, window_id, count(*) FILTER (n > 1) split_candidates FROM b GROUP BY ALL) USING (site_id, window_id)"""))
def match_candidates(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    return C.contention(C.candidate_matches(truth, pieces))


@query("A7_mean_matched_iou", B.with_ctes(GREEDY, """SELECT site_id, round(sum(m * n) / sum(n), 6) mean_matched_iou, CAST(sum(n) AS BIGINT) matched
  FROM (SELECT site_id, window_id, avg(iou) m, count(*) n FROM mt GROUP BY ALL) GROUP BY ALL""", True))
def mean_iou(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    per = C.greedy_match(C.candidate_matches(truth, pieces)).groupBy("site_id", "window_id").agg(F.avg("iou").alias("m"), F.count("*").alias("n"))
    return per.groupBy("site_id").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean_matched_iou"), F.sum("n").alias("matched"))


DIAG = WIN + """,
covn AS (SELECT site_id, window_id, pred, count(*) k FROM ov WHERE inter * 2 > tn GROUP BY ALL),
bestp AS (SELECT site_id, window_id, label, arg_min(pred, (-inter, pred)) pred, max(inter) inter FROM ov GROUP BY ALL),
diag AS (SELECT t.site_id, t.window_id, t.label_id, t.n cells, b.inter, o.pn, coalesce(k, 0) labels_in,
  b.inter / (o.pn + t.n - b.inter) iou, b.inter / t.n cov
  FROM (SELECT DISTINCT site_id, window_id, label_id, n FROM tc) t LEFT JOIN bestp b ON t.site_id=b.site_id AND t.window_id=b.window_id AND t.label_id=b.label
  LEFT JOIN ov o ON o.site_id=b.site_id AND o.window_id=b.window_id AND o.pred=b.pred AND o.label=b.label
  LEFT JOIN covn c ON c.site_id=b.site_id AND c.window_id=b.window_id AND c.pred=b.pred)"""


@query("A10_failure_classes", B.with_ctes(DIAG, """SELECT site_id, window_id, label_id, cells,
  CASE WHEN inter IS NULL THEN 'missed' WHEN iou >= 0.5 THEN 'matched' WHEN cov >= 0.5 AND labels_in >= 2 THEN 'merged'
   WHEN cov < 0.5 THEN 'partial' ELSE 'oversized' END failure,
  round(coalesce(iou,0), 6) iou, round(coalesce(cov,0), 6) coverage, labels_in FROM diag"""))
def failures(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)
    return C.failure_classes(truth, pieces).withColumn("iou", F.round("iou", 6)).withColumn("coverage", F.round("coverage", 6))


@query("W6_best_prediction", B.with_ctes(WIN, """SELECT site_id, window_id, label AS label_id, arg_min(pred, (-inter, pred)) best_pred,
  max(inter) inter, any_value(d) pred_labels FROM (SELECT *, count(*) OVER (PARTITION BY site_id, window_id, pred) d FROM ov)
  GROUP BY site_id, window_id, label""").replace("any_value(d)", "arg_min(d, (-inter, pred))"))
def best_prediction(spark, folder):
    preds, labels, win = inputs(spark, folder)
    truth, _, pieces = C.prepare(preds, labels, win, MIN_CELLS)

    def form(df):
        return df.select("site_id", "window_id", "id", "spans", "cells")
    two = P.overlap_pairs(form(pieces), form(truth), C.WKEYS)
    per_pred = two.groupBy(*C.WKEYS, "a").agg(F.count("*").alias("pred_labels"))
    best = two.groupBy(*C.WKEYS, "b").agg(F.min(F.struct((-F.col("inter")).alias("neg"), "a")).alias("m"))
    return (best.select(*C.WKEYS, F.col("b").alias("label_id"), F.col("m.a").alias("a"), (-F.col("m.neg")).alias("inter"))
            .join(dealt(per_pred), [*C.WKEYS, "a"]).withColumnRenamed("a", "best_pred"))


@query("A35_total_overlap", B.with_ctes(B.CELLS, """SELECT site_id, CAST(sum(n*(n-1)//2) AS BIGINT) overlap_cells
  FROM (SELECT site_id, r, c, count(*) n FROM cells GROUP BY ALL) WHERE n > 1 GROUP BY ALL"""))
def total_overlap(spark, folder):
    sp = S.explode_spans(B.covered(B.footprints(spark, folder), "feature_id"), "site_id")
    return P.total_overlap(sp, ["site_id"])


@query("A20_label_counts", B.with_ctes(B.LABELS, """SELECT site_id, window_id, count(*) FILTER (ign) ignored,
  count(*) FILTER (NOT ign) buildings, count(*) FILTER (NOT ign AND confidence='high') high,
  count(*) FILTER (NOT ign AND confidence='medium') medium FROM lab GROUP BY ALL"""))
def label_counts(spark, folder):
    return B.labels(spark, folder).groupBy("site_id", "window_id").agg(
        F.count_if(F.expr("ignore")).alias("ignored"), F.count_if(F.expr("not ignore")).alias("buildings"),
        F.count_if(F.expr("not ignore and confidence = 'high'")).alias("high"),
        F.count_if(F.expr("not ignore and confidence = 'medium'")).alias("medium"))


@query("S14_score_report", B.with_ctes(SCORES, """SELECT site_id, count(*) FILTER (window_id IS NOT NULL) windows,
  max(CASE WHEN window_id IS NULL THEN tp END) overall_tp, CAST(sum(CASE WHEN window_id IS NOT NULL THEN tp END) AS BIGINT) window_tp
  FROM sc GROUP BY site_id""", True))
def score_report(spark, folder):
    """Nested JSON report per site, read back and summarised."""
    from gridfold.sources.sinks import score_report as nest
    nested = nest(C.score(*inputs(spark, folder), MIN_CELLS))
    schema = "overall struct<tp:bigint>, per_window map<string,struct<tp:bigint>>"
    back = nested.select("site_id", F.from_json("report", schema).alias("r"))
    return back.select("site_id", F.size("r.per_window").cast("long").alias("windows"), F.col("r.overall.tp").alias("overall_tp"),
                       F.aggregate(F.map_values("r.per_window"), F.lit(0).cast("long"), lambda a, v: a + v.tp).alias("window_tp"))


@query("Q6_approval_gate", B.with_ctes(B.LABELS, """SELECT site_id, count(*) FILTER (confidence <> 'high') pending,
  count(*) FILTER (confidence <> 'high') = 0 AS passed FROM lab GROUP BY ALL"""))
def approval_gate(spark, folder):
    labels = B.labels(spark, folder).withColumn("status", F.expr("case confidence when 'high' then 'approved' else 'draft' end"))
    return labels.groupBy("site_id").agg(F.count_if(F.col("status") != "approved").alias("pending"),
                                         (F.count_if(F.col("status") != "approved") == 0).alias("passed"))
