"""Grid coverage of polygons as row spans, and set algebra on spans.

A span ``(row, c0, c1)`` covers the cells ``c0 <= col < c1`` whose centres lie inside the
polygon (even-odd rule).  Coverage is a projection (no shuffle).  Set algebra is a sweep:
spans become +1/-1 events, pre-aggregated per ``(site, row, column bucket, column)``, so one
group never holds more than a bucket's width of rows however many polygons pile up there.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.functions.kernels import SPAN, gap_sq, shared_cells, span_array  # noqa: F401
from gridfold.session import dealt, pin

BUCKET = 64  # columns per bucket


def _cell(v: Column, res: float) -> Column:
    return F.ceil(v / res - 0.5).cast("int")


def coverage(features: DataFrame, res: float, rings: str = "rings", prefix: str = "") -> DataFrame:
    """Adds ``spans`` and ``cells`` (cell count) in one projection, their names with ``prefix``."""
    d = pin(features, **{f"{prefix}spans": span_array(M.segments(F.col(rings)), res)})
    return pin(d, **{f"{prefix}cells": cell_count(F.col(f"{prefix}spans"))})


def coverage_by_edges(features: DataFrame, keys: list[str], res: float, rings: str = "rings") -> DataFrame:
    """The same coverage for outlines with very many edges: ``keys, row, c0, c1``.

    Each edge is exploded to the rows it crosses, so the work is the number of crossings, not
    rows x edges, and one huge outline spreads over tasks by (keys, row).
    """
    seg = features.select(*keys, F.explode(M.segments(F.col(rings))).alias("s"))
    lo, hi = F.least("s.y1", "s.y2"), F.greatest("s.y1", "s.y2")
    hits = (seg.withColumn("r0", _cell(lo, res)).withColumn("r1", _cell(hi, res) - 1).where("r1 >= r0")
            .select(*keys, "s", F.explode(F.sequence("r0", "r1")).alias("row"))
            .select(*keys, "row", _cell(F.col("s.x1") + ((F.col("row") + 0.5) * res - F.col("s.y1"))
                                        / (F.col("s.y2") - F.col("s.y1")) * (F.col("s.x2") - F.col("s.x1")), res).alias("x")))
    w = Window.partitionBy(*keys, "row").orderBy("x")
    return (hits.withColumn("c1", F.lead("x").over(w)).withColumn("i", F.row_number().over(w))
            .where("i % 2 = 1 and c1 > x").select(*keys, "row", F.col("x").alias("c0"), "c1"))


def cell_count(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s.c1 - s.c0))


def explode_spans(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("spans").alias("s")).select(*keep, "s.row", "s.c0", "s.c1")


def split_spans(spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Cut spans at bucket borders: every piece lies in exactly one bucket."""
    b0, b1 = F.floor(F.col("c0") / bucket).cast("int"), F.floor((F.col("c1") - 1) / bucket).cast("int")
    return (spans.withColumn("bucket", F.explode(F.sequence(b0, b1)))
            .withColumn("c0", F.greatest("c0", F.col("bucket") * bucket))
            .withColumn("c1", F.least("c1", (F.col("bucket") + 1) * bucket)))


def to_cells(spans: DataFrame) -> DataFrame:
    return spans.withColumn("col", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1))).drop("c0", "c1")


def under_spans(spans: DataFrame, cells: DataFrame, keys: list[str], *values: str, bucket: int = BUCKET) -> DataFrame:
    """``values`` of the cells (``keys, row, col``, each once) that lie under each span: the columns of ``spans`` but its
    place.  Stretches of a row meet, not single cells, so spans are shuffled and not what they cover."""
    at = (F.col("col") - F.col("bucket") * bucket).cast("int")
    line = (cells.withColumn("bucket", F.floor(F.col("col") / bucket).cast("int")).groupBy(*keys, "row", "bucket")
            .agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.struct(*values).alias("v")))).alias("m"))
            .select(*keys, "row", "bucket", F.transform(F.sequence(F.lit(0), F.lit(bucket - 1)), lambda i: F.col("m")[i]).alias("line")))
    both = split_spans(spans, bucket).join(dealt(line), [*keys, "row", "bucket"])
    part = F.slice("line", (F.col("c0") - F.col("bucket") * bucket + 1).cast("int"), (F.col("c1") - F.col("c0")).cast("int"))
    keep = [c for c in spans.columns if c not in ("row", "c0", "c1")]
    return both.select(*keep, F.explode(part).alias("v")).where("v is not null").select(*keep, "v.*")


def overlay(layers: dict[str, DataFrame], keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Elementary spans with one coverage count per layer.

    Every layer has ``keys, row, c0, c1``.  Output: ``keys, row, c0, c1`` and per layer the
    number of its spans over that stretch; only stretches covered by some layer appear.
    """
    events = None
    for name, df in layers.items():
        cut = split_spans(df.select(*keys, "row", "c0", "c1"), bucket)
        e = cut.select(*keys, "row", "bucket", F.explode(F.array(
            F.struct(F.col("c0").alias("pos"), F.lit(1).cast("long").alias("d")),
            F.struct(F.col("c1").alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("e"))
        e = e.select(*keys, "row", "bucket", "e.pos",
                     *[(F.col("e.d") if n == name else F.lit(0).cast("long")).alias(n) for n in layers])
        events = e if events is None else events.unionByName(e)
    group = [*keys, "row", "bucket"]
    steps = events.groupBy(*group, "pos").agg(*[F.sum(n).alias(n) for n in layers])
    w = Window.partitionBy(*group).orderBy("pos")
    return (steps.select(*group, F.col("pos").alias("c0"), F.lead("pos").over(w).alias("c1"),
                         *[F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in layers])
            .where(F.col("c1").isNotNull() & (F.greatest(*layers) > 0 if len(layers) > 1 else F.col(list(layers)[0]) > 0))
            .drop("bucket"))


def _bits() -> Column:
    """Bits of the columns c0 to c1 - 1 inside their bucket of 64."""
    return F.expr("shiftleft(-1L, c0 - bucket * 64) & shiftrightunsigned(-1L, (bucket + 1) * 64 - c1)")


def bit_rows(layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The dissolved cells of every layer (``keys, row, c0, c1``) as one long for each 64 columns: ``keys, row,
    bucket`` and per layer the bits that it covers.  Without counts no order is needed, so it is one aggregate."""
    rows = None
    for name, df in layers.items():
        r = split_spans(df.select(*keys, "row", "c0", "c1").where("c1 > c0"), 64)
        r = r.select(*keys, "row", "bucket", *[(_bits() if n == name else F.lit(0).cast("long")).alias(n) for n in layers])
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(*keys, "row", "bucket").agg(*[F.bit_or(n).alias(n) for n in layers])


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Dissolve: the covered cells, each once."""
    return overlay({"n": spans}, keys).drop("n")


def difference_spans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return overlay({"a": a, "b": b}, keys).where("a > 0 and b = 0").select(*keys, "row", "c0", "c1")


def span_cells() -> Column:
    return (F.col("c1") - F.col("c0")).cast("long")


def overlap_with(features: DataFrame, zone: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Cells of each feature that a dissolved zone covers: ``ids, covered``.

    ``zone`` must be dissolved (``union_spans``), so each bucket row holds disjoint pieces.
    """
    a = split_spans(features.select(*dict.fromkeys([*keys, *ids]), "row", "c0", "c1"))
    b = split_spans(zone.select(*keys, "row", "c0", "c1")).withColumnsRenamed({"c0": "z0", "c1": "z1"})
    both = a.join(dealt(b), [*keys, "row", "bucket"]).where("z0 < c1 and c0 < z1")
    return both.groupBy(*ids).agg(F.sum(F.least("c1", "z1") - F.greatest("c0", "z0")).cast("long").alias("covered"))


def covered_cells(pieces: DataFrame, zone: DataFrame, keys: list[str], ids: list[str], rows: int = 16) -> DataFrame:
    """Cells of each span array that a zone (``keys, row, c0, c1``, may overlap itself) covers: ``ids, covered``,
    for those that it meets.

    The zone becomes tiles of ``rows`` x 64 cells in bits; a piece goes to the tiles that its spans touch.
    """
    bits = bit_rows({"z": zone}, keys).withColumn("tr", F.floor(F.col("row") / rows))
    tiles = bits.groupBy(*keys, "tr", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("row", "z"))).alias("z"))
    touched = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.transform(
        F.sequence(F.floor(s.c0 / 64).cast("int"), F.floor((s.c1 - 1) / 64).cast("int")),
        lambda b: F.struct(F.floor(s.row / rows).alias("tr"), b.alias("bucket"))))))
    names = list(dict.fromkeys([*keys, *ids]))
    both = pieces.select(*names, "spans", F.explode(touched).alias("t")).select(*names, "spans", "t.tr", "t.bucket").join(dealt(tiles), [*keys, "tr", "bucket"])
    both = both.select(*names, "tr", "bucket", "z", F.explode("spans").alias("s")).where(F.floor(F.col("s.row") / rows) == F.col("tr"))
    both = both.select(*names, "bucket", F.col("z")[F.col("s.row")].alias("z"), F.greatest(F.col("s.c0"), F.col("bucket") * 64).alias("c0"),
                       F.least(F.col("s.c1"), (F.col("bucket") + 1) * 64).alias("c1")).where("c1 > c0 and z is not null")
    return both.groupBy(*ids).agg(F.sum(F.bit_count(_bits().bitwiseAND(F.col("z"))).cast("long")).alias("covered"))


# ---- expressions on two span arrays (used after a candidate join; one row per pair) ----

def minus(a: Column, b: Column) -> Column:
    """Part of a span array outside another, in the order of ``a``."""
    def piece(row, c0, c1):
        return F.struct(row.alias("row"), c0.cast("int").alias("c0"), c1.cast("int").alias("c1"))

    def less(p, t):
        return F.filter(F.array(piece(p.row, p.c0, F.least(p.c1, t.c0)), piece(p.row, F.greatest(p.c0, t.c1), p.c1)), lambda q: q.c1 > q.c0)
    return F.flatten(F.transform(a, lambda s: F.aggregate(F.filter(b, lambda t: t.row == s.row), F.array(piece(s.row, s.c0, s.c1)),
                                                          lambda rest, t: F.flatten(F.transform(rest, lambda p: less(p, t))))))


def clip(spans: Column, r0: Column, r1: Column, c0: Column, c1: Column) -> Column:
    """Part of a span array inside rows [r0, r1) and columns [c0, c1)."""
    cut = F.transform(spans, lambda s: F.struct(s.row.alias("row"), F.greatest(s.c0, c0).cast("int").alias("c0"),
                                                F.least(s.c1, c1).cast("int").alias("c1")))
    return F.filter(cut, lambda s: (s.row >= r0) & (s.row < r1) & (s.c1 > s.c0))


def stacked(spans: Column) -> Column:
    """True when each row has one span and every span touches the one before: surely one part."""
    n = F.size(spans)
    ok = F.zip_with(F.slice(spans, 1, F.greatest(n - 1, F.lit(0))), F.slice(spans, 2, F.greatest(n - 1, F.lit(0))),
                    lambda a, b: (b.row == a.row + 1) & (a.c0 < b.c1) & (b.c0 < a.c1))
    return (n <= 1) | F.forall(ok, lambda v: v)


def interior_point(spans: Column, res: float) -> Column:
    """Representative point: centre of the widest span on the middle covered row."""
    mid = F.floor((F.array_min(F.transform(spans, lambda s: s.row)) + F.array_max(F.transform(spans, lambda s: s.row))) / 2)
    rows = F.transform(F.filter(spans, lambda s: s.row == mid), lambda s: F.struct(
        (s.c0 - s.c1).alias("k"), s.c0.alias("c0"), s.c1.alias("c1")))
    w = F.array_min(rows)
    return F.struct(((w.c0 + w.c1) * res / 2).alias("x"), ((mid + 0.5) * res).alias("y"))
