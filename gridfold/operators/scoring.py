"""Pixel and object scores of footprints against reviewed labels, per window and overall."""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.functions import kernels as N
from gridfold.operators import pairs as P
from gridfold.operators import spans as S
from gridfold.operators.components import span_parts
from gridfold.operators.merging import per_group
from gridfold.session import cut, dealt

WKEYS = ["site_id", "window_id"]


def ratio(a, b) -> Column:
    """a / b as double; NULL when b is zero."""
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip_to_windows(features: DataFrame, windows: DataFrame, min_cells: float, own_window: bool = False) -> DataFrame:
    """Parts of each feature (``site_id, id, spans``) inside each window: ``site_id, window_id,
    id, part, spans, cells``; parts under ``min_cells`` are dropped.

    ``own_window``: features carry ``window_id`` and are clipped only to that window.
    """
    if own_window:
        both = features.join(dealt(windows), WKEYS)
    else:
        both = P.box_join(P.with_box(features), windows, ["site_id"], box=256).withColumnsRenamed(
            {"o_window_id": "window_id", "r0": "f_r0", "r1": "f_r1", "k0": "f_k0", "k1": "f_k1",
             "o_r0": "r0", "o_r1": "r1", "o_k0": "k0", "o_k1": "k1"})
    pieces = both.select(*WKEYS, "id", S.clip(F.col("spans"), F.col("r0"), F.col("r1"), F.col("k0"), F.col("k1")).alias("spans"))
    return span_parts(pieces, [*WKEYS, "id"]).where(F.col("cells") >= min_cells)


def drop_ignored(pieces: DataFrame, ignore: DataFrame) -> DataFrame:
    """Remove predictions covered by ignore regions by more than half (exactly half stays)."""
    ids = [*WKEYS, "id", "part"]
    pieces = cut(pieces)
    covered = S.covered_cells(pieces, S.explode_spans(ignore, *WKEYS), WKEYS, ids)
    return pieces.join(dealt(covered), ids, "left").where(F.coalesce("covered", F.lit(0)) * 2 <= F.col("cells")).drop("covered")


def pixel_counts(labels: DataFrame, preds: DataFrame, ignore: DataFrame, windows: DataFrame,
                 nodata: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn and evaluated cells per window from the bit rows of all span layers.

    Evaluated cells = window cells minus excluded cells, so no dense grid appears.
    """
    layers = {"lab": S.explode_spans(labels, *WKEYS), "pred": S.explode_spans(preds, *WKEYS),
              "skip": S.explode_spans(ignore, *WKEYS)}
    if nodata is not None:
        layers["skip"] = layers["skip"].unionByName(nodata.select(*WKEYS, "row", "c0", "c1"))

    def total(bits):
        return F.coalesce(F.sum(F.bit_count(F.expr(bits)).cast("long")), F.lit(0).cast("long"))

    counts = S.bit_rows(layers, WKEYS).groupBy(*WKEYS).agg(
        total("lab & pred & ~skip").alias("tp"), total("~lab & pred & ~skip").alias("fp"),
        total("lab & ~pred & ~skip").alias("fn"), total("skip").alias("skipped"))
    size = ((F.col("r1") - F.col("r0")) * (F.col("k1") - F.col("k0"))).cast("long")
    zero = F.lit(0).cast("long")
    return windows.join(dealt(counts), WKEYS, "left").select(
        *WKEYS, *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")],
        (size - F.coalesce("skipped", zero)).alias("eval_px"))


def candidate_matches(labels: DataFrame, preds: DataFrame, min_iou: float = T.MATCH_IOU, keys=WKEYS) -> DataFrame:
    """Pairs with IoU >= ``min_iou``: ``keys, pred, label, iou, inter``.  Ids are ordered structs."""
    def form(df):
        return df.select(*keys, F.struct("id", "part").alias("id"), "spans", "cells")
    two = P.overlap_pairs(form(preds), form(labels), keys)
    iou = F.col("inter") / (F.col("a_cells") + F.col("b_cells") - F.col("inter"))
    return two.select(*keys, F.col("a").alias("pred"), F.col("b").alias("label"), iou.alias("iou"), "inter").where(F.col("iou") >= min_iou)


def greedy_match(pairs: DataFrame, keys=WKEYS) -> DataFrame:
    """One-to-one matching by descending IoU; ties take the larger pred id, then label id.

    The order is strict, so repeatedly accepting pairs that are best for both of their ends
    gives exactly the sequential result; each round is two grouped maxima and a join.
    """
    left = cut(pairs.select(*keys, "pred", "label", "iou"))
    matched = None
    while not left.isEmpty():
        key = F.struct("iou", "pred", "label")
        by_pred = left.groupBy(*keys, "pred").agg(F.max(key).alias("bp"))
        by_label = left.groupBy(*keys, "label").agg(F.max(key).alias("bl"))
        best = cut(by_pred.select(*keys, F.col("bp.iou").alias("iou"), "pred", F.col("bp.label").alias("label"))
                   .join(dealt(by_label.select(*keys, "label", F.col("bl.pred").alias("pred"))), [*keys, "pred", "label"]))
        matched = best if matched is None else matched.unionByName(best)
        left = cut(left.join(dealt(best.select(*keys, "pred")), [*keys, "pred"], "left_anti")
                   .join(dealt(best.select(*keys, "label")), [*keys, "label"], "left_anti"))
    return left.select(*keys, "pred", "label", "iou") if matched is None else matched.select(*keys, "pred", "label", "iou")


def best_matching(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Of the pairs (u, v, gain > 0) as many as possible with every u and v used once, and of all
    such choices one with the largest sum of gains.

    Shortest augmenting paths with potentials over neighbour lists: a search touches only the
    pairs it needs, and memory is in proportion to their number.  Each u also has a costly place of its
    own, where it ends up if it stays single.
    """
    near: dict[int, list[tuple[object, float]]] = {}
    for u, v, gain in pairs:
        near.setdefault(u, []).append((v, -gain))
    single = 1.0 + 2.0 * sum(max(-c for _, c in ways) for ways in near.values())
    for u, ways in near.items():
        ways.append((("single", u), single))
    rise: dict[int, float] = dict.fromkeys(near, 0.0)
    fall: dict[object, float] = {}
    holder: dict[object, int] = {}
    place: dict[int, object] = {}
    for start in sorted(near):
        far, came, done, heap, order = {}, {}, {}, [], 0
        u, base = start, 0.0
        while True:
            for v, cost in near[u]:
                reach = base + cost - rise[u] - fall.get(v, 0.0)
                if v not in done and (v not in far or reach < far[v]):
                    far[v], came[v] = reach, u
                    order += 1
                    heapq.heappush(heap, (reach, order, v))
            base, _, v = heapq.heappop(heap)
            while v in done or base > far[v]:  # an entry that a shorter way has replaced
                base, _, v = heapq.heappop(heap)
            if v not in holder:
                break
            done[v] = base
            u = holder[v]
        rise[start] += base
        for w, reach in done.items():
            rise[holder[w]] += base - reach
            fall[w] = fall.get(w, 0.0) - (base - reach)
        while True:  # every u on the way moves on to the next place
            u = came[v]
            old = place.get(u)
            holder[v], place[u] = u, v
            if u == start:
                break
            v = old
    return [(u, v) for v, u in holder.items() if not isinstance(v, tuple)]


def optimal_match(pairs: DataFrame, keys=WKEYS) -> DataFrame:
    """Matching with the most eligible pairs, then the largest IoU sum: ``keys, pred, label, iou``.

    Only pairs that compete for an end need solving: a pair whose ends occur once is a match
    outright.  The rest is solved per component of the eligible graph; overlap keeps these small, since an IoU of 0.5 limits how many shapes can contend.
    """
    from gridfold.operators.components import graph_components
    pairs = cut(pairs.select(*keys, "pred", "label", "iou"))
    for end in ("pred", "label"):
        busy = pairs.groupBy(*keys, end).agg((F.count("*") > 1).alias(f"_{end}"))
        pairs = pairs.join(dealt(busy), [*keys, end])
    pairs = cut(pairs)
    free = pairs.where("not _pred and not _label").select(*keys, "pred", "label", "iou")
    rest = pairs.where("_pred or _label").select(*keys, "pred", "label", "iou")
    for end, node, odd in (("pred", "u", 0), ("label", "v", 1)):  # ends of any type become numbers; places in a checkpoint stay
        names = cut(rest.select(*keys, end).distinct()).withColumn(node, F.monotonically_increasing_id() * 2 + odd)
        rest = rest.join(dealt(names), [*keys, end])
    rest = cut(rest)
    roots = graph_components(rest.select(*keys, "u", "v"), list(keys)).withColumnRenamed("node", "u")
    schema = ", ".join(f"{k} {rest.schema[k].dataType.simpleString()}" for k in keys) + ", u long, v long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = best_matching(list(pdf[["u", "v", "iou"]].itertuples(index=False, name=None)))
        return pd.DataFrame(got, columns=["u", "v"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "u", "v"]]

    won = per_group(cut(rest.join(dealt(roots), [*keys, "u"]).select(*keys, "root", "u", "v", "iou")), [*keys, "root"], solve, schema)
    return free.unionByName(rest.join(dealt(won), [*keys, "u", "v"], "left_semi").select(*keys, "pred", "label", "iou"))


def contention(pairs: DataFrame, keys=WKEYS) -> DataFrame:
    """Merge candidates (predictions eligible for several labels) and split candidates (labels
    eligible for several predictions) per key."""
    def many(side, name):
        return pairs.groupBy(*keys, side).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias(name))
    return many("pred", "merge_candidates").join(dealt(many("label", "split_candidates")), list(keys))


def object_counts(matches: DataFrame, labels: DataFrame, preds: DataFrame, windows: DataFrame) -> DataFrame:
    got = matches.groupBy(*WKEYS).agg(F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"))
    zero = F.lit(0).cast("long")
    return (windows.select(*WKEYS).join(dealt(got), WKEYS, "left")
            .join(dealt(preds.groupBy(*WKEYS).agg(F.count("*").alias("n_pred"))), WKEYS, "left")
            .join(dealt(labels.groupBy(*WKEYS).agg(F.count("*").alias("n_label"))), WKEYS, "left")
            .select(*WKEYS, *[F.coalesce(c, zero).alias(c) for c in ("matched", "n_pred", "n_label")], "iou_sum"))


def metrics(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """Per-window and micro-averaged rows in one pass; ratios are NULL on empty denominators.
    The overall row has ``window_id`` NULL; its mean IoU weights windows by matches."""
    sums = ["tp", "fp", "fn", "eval_px", "matched", "n_pred", "n_label", "iou_sum"]
    both = pixels.join(dealt(objects), WKEYS)
    agg = both.groupingSets([["site_id", "window_id"], ["site_id"]], "site_id", "window_id").agg(*[F.sum(c).alias(c) for c in sums])
    return agg.select(
        *WKEYS, "tp", "fp", "fn", "eval_px", "matched", "n_pred", "n_label",
        ratio("tp", F.col("tp") + F.col("fp")).alias("pixel_precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("pixel_recall"),
        ratio("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("pixel_iou"),
        ratio("matched", "n_pred").alias("building_precision"), ratio("matched", "n_label").alias("building_recall"),
        ratio("iou_sum", "matched").alias("mean_matched_iou"))


def prepare(preds: DataFrame, labels: DataFrame, windows: DataFrame, min_cells: float):
    """Clipped label, ignore and (ignore-filtered) prediction pieces."""
    truth = clip_to_windows(labels.where("not ignore"), windows, min_cells, own_window=True)
    ignore = clip_to_windows(labels.where("ignore"), windows, 0, own_window=True)
    pieces = drop_ignored(clip_to_windows(preds, windows, min_cells), ignore)
    return truth, ignore, pieces


def score(preds: DataFrame, labels: DataFrame, windows: DataFrame, min_cells: float,
          nodata: DataFrame | None = None) -> DataFrame:
    """Full scoring of one layer; inputs carry ``site_id, id, spans`` (labels also
    ``window_id, ignore``).  Refuses nothing itself: see ``quality.approval_gate``."""
    truth, ignore, pieces = prepare(preds, labels, windows, min_cells)
    truth, pieces = cut(truth), cut(pieces)
    pixels = pixel_counts(truth, pieces, ignore, windows, nodata)
    matches = greedy_match(candidate_matches(truth, pieces))
    return metrics(pixels, object_counts(matches, truth, pieces, windows))


def failure_classes(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """Failure class of each label piece: matched, merged, partial, oversized or missed.

    Largest overlap decides (ties: first prediction); ``merged`` needs the prediction to cover
    more than half of at least two labels.
    """
    lab = labels.select(*WKEYS, F.struct("id", "part").alias("id"), "spans", "cells")
    prd = preds.select(*WKEYS, F.struct("id", "part").alias("id"), "spans", "cells")
    two = P.overlap_pairs(prd, lab, WKEYS)
    covers = two.where("inter * 2 > b_cells").groupBy(*WKEYS, "a").agg(F.count("*").alias("labels_in"))
    best = two.groupBy(*WKEYS, "b").agg(F.min(F.struct(
        (-F.col("inter")).alias("neg"), F.col("a").alias("pred"), F.col("a_cells").alias("p_cells"))).alias("m"))
    best = best.select(*WKEYS, F.col("b").alias("id"), (-F.col("m.neg")).alias("inter"), F.col("m.pred").alias("a"), "m.p_cells")
    got = best.join(dealt(covers), [*WKEYS, "a"], "left").withColumn("labels_in", F.coalesce("labels_in", F.lit(0).cast("long")))
    iou = F.col("inter") / (F.col("p_cells") + F.col("cells") - F.col("inter"))
    cov = F.col("inter") / F.col("cells")
    return lab.join(dealt(got), [*WKEYS, "id"], "left").select(
        *WKEYS, F.col("id.id").alias("label_id"), F.col("cells"),
        F.when(F.col("inter").isNull(), "missed").when(iou >= 0.5, "matched")
        .when((cov >= 0.5) & (F.col("labels_in") >= 2), "merged").when(cov < 0.5, "partial").otherwise("oversized").alias("failure"),
        F.coalesce(iou, F.lit(0.0)).alias("iou"), F.coalesce(cov, F.lit(0.0)).alias("coverage"),
        F.coalesce("labels_in", F.lit(0).cast("long")).alias("labels_in"))


def confusion(pairs: DataFrame, classes: DataFrame, keys: list[str], void: int = T.VOID) -> DataFrame:
    """Confusion counts ``keys, ref, pred, n`` with every class pair present; void is skipped.

    ``classes`` holds the class ids, however many; the pairs of all of them are the result itself.
    Rows whose class is outside the schema come back with ``valid = false``.
    """
    seen = pairs.where(F.col("ref") != void).groupBy(*keys, "ref", "pred").agg(F.count("*").alias("n"))
    listed = classes.agg(F.collect_set("class_id").alias("cs"))
    grid = (seen.select(*keys).distinct().withColumn("_j", F.lit(1)).join(listed.withColumn("_j", F.lit(1)), "_j")
            .withColumn("ref", F.explode("cs")).withColumn("pred", F.explode("cs")).drop("cs", "_j").withColumn("valid", F.lit(True)))
    return grid.join(seen, [*keys, "ref", "pred"], "full").select(
        *keys, "ref", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("valid", F.lit(False)).alias("valid"))


def class_scores(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class tp, IoU, precision, recall, F1 and the macro IoU over defined classes."""
    rows = matrix.groupBy(*keys, F.col("ref").alias("class_id")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(*keys, F.col("pred").alias("class_id")).agg(F.sum("n").alias("predicted"))
    per = rows.join(cols, [*keys, "class_id"])
    union = F.col("actual") + F.col("predicted") - F.col("tp")
    per = per.select(*keys, "class_id", "actual", "predicted", "tp", ratio("tp", union).alias("iou"),
                     ratio("tp", "predicted").alias("precision"), ratio("tp", "actual").alias("recall"),
                     ratio(F.col("tp") * 2, F.col("actual") + F.col("predicted")).alias("f1"))
    macro = per.groupBy(*keys).agg(F.avg("iou").alias("macro_iou"))
    return per.join(macro, keys) if keys else per.withColumn("_j", F.lit(1)).join(F.broadcast(macro.withColumn("_j", F.lit(1))), "_j").drop("_j")


def boundary_scores(pairs: DataFrame, tol: float, step: float) -> DataFrame:
    """Boundary precision/recall within ``tol`` and Hausdorff distance of geometry pairs.

    ``pairs`` has ``ref`` and ``pred`` segment arrays.  Shares are NULL when a boundary is empty.
    """
    ref, pred = F.col("ref"), F.col("pred")
    return pairs.withColumns({"boundary_precision": N.covered_share(pred, ref, step, tol), "boundary_recall": N.covered_share(ref, pred, step, tol),
                              "hausdorff": F.sqrt(F.greatest(N.farthest_sq(ref, pred), N.farthest_sq(pred, ref)))})
