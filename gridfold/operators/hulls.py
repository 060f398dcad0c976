"""Convex hulls of cell regions and their smallest rotated rectangles.

A hull of hulls is the hull of all, so a region is first reduced per row to its outermost corners, then
per band of rows to a hull, and only the bands' hulls meet in one group.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.operators.merging import per_group

BAND = 1024  # rows whose corners make one hull first


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counter-clockwise hull of integer points by monotone chains, without points on its sides."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order):
        out: list[tuple[int, int]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]
    return half(points) + half(points[::-1])


def smallest_rectangle(hull: list[tuple[int, int]]) -> tuple[float, float]:
    """Longer and shorter side of the rotated rectangle of least area around a hull (of equal areas the longest)."""
    at = np.array(hull, np.int64)
    side = np.roll(at, -1, axis=0) - at
    along, across = at @ side.T, at @ np.stack([-side[:, 1], side[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    square = (side ** 2).sum(axis=1)
    area, longest = a * b / square, np.maximum(a, b) ** 2 / square
    i = np.lexsort((-longest, area))[0]
    return float(np.sqrt(longest[i])), float(np.sqrt(np.minimum(a, b)[i] ** 2 / square[i]))


def region_sides(cells: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, long_side, short_side`` in cells of the smallest rotated rectangle around each region of cells (``ids, row, col``)."""
    ends = cells.groupBy(*ids, "row").agg(F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    corners = ends.select(*ids, F.floor(F.col("row") / BAND).alias("band"), F.explode(F.array("row", F.col("row") + 1)).alias("y"), "c0", "c1")
    corners = corners.select(*ids, "band", "y", F.explode(F.array("c0", "c1")).alias("x")).distinct()
    head = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in ids)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist())))
        return pd.DataFrame(hull, columns=["x", "y"]).assign(**{k: pdf[k].iloc[0] for k in ids})[[*ids, "x", "y"]]

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = smallest_rectangle(convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist()))))
        return pd.DataFrame([sides], columns=["long_side", "short_side"]).assign(**{k: pdf[k].iloc[0] for k in ids})[[*ids, "long_side", "short_side"]]

    bands = per_group(corners, [*ids, "band"], one, f"{head}, x long, y long")
    return per_group(bands, ids, last, f"{head}, long_side double, short_side double")
