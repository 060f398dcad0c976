"""Connected parts of span arrays, and one array without another."""
import random

from pyspark.sql import functions as F

from gridfold.operators import spans as S
from gridfold.operators.components import span_parts

SPANS = "id long, spans array<struct<row:int,c0:int,c1:int>>"


def parts_of(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
            left -= near
            todo += near
        out.append(frozenset(part))
    return sorted(out, key=sorted)


def cells_of(spans):
    return {(s["row"], c) for s in spans for c in range(s["c0"], s["c1"])}


def random_piece(dice):
    cells = {(r, c) for r in range(-3, 5) for c in range(-4, 9) if dice.random() < 0.6}
    return [{"row": r, "c0": c, "c1": c + 1} for r, c in sorted(cells)]


def test_parts_against_flooding_without_a_shuffle(spark):
    dice = random.Random(4)
    rows = [(i, random_piece(dice)) for i in range(200)] + [(200, []), (201, [{"row": 2_000_000_000, "c0": -1_000_000_000, "c1": 1_000_000_000}])]
    out = span_parts(spark.createDataFrame(rows, SPANS), ["id"])
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString() and "ExistingRDD" in out._jdf.queryExecution().sparkPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(r)
    assert 200 not in got and got[201][0].cells == 2_000_000_000
    for i, spans in rows[:200]:
        assert sorted((frozenset(cells_of([s.asDict() for s in r.spans])) for r in got[i]), key=sorted) == parts_of(cells_of(spans))
        assert all(r.cells == len(cells_of([s.asDict() for s in r.spans])) for r in got[i]) and len({r.part for r in got[i]}) == len(got[i])


def test_minus(spark):
    dice = random.Random(5)
    rows = [(i, random_piece(dice), [{"row": r, "c0": (c := dice.randrange(-6, 8)), "c1": c + dice.randrange(1, 4)} for r in range(-3, 5)]) for i in range(100)]
    d = spark.createDataFrame(rows, SPANS + ", b array<struct<row:int,c0:int,c1:int>>").select("id", S.minus(F.col("spans"), F.col("b")).alias("m"))
    for r in d.collect():
        assert cells_of([s.asDict() for s in r.m]) == cells_of(rows[r.id][1]) - cells_of(rows[r.id][2])
