"""Ordered lines against a plain walk."""
import random

import pytest

from gridfold.operators import chains as C


def walk(edges):
    """All lines of one graph by following edges one at a time."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    lines, used = set(), set()

    def follow(u, v, stop):
        path = [u, v]
        while not stop(path[-1]):
            path.append(next(w for w in near[path[-1]] if w != path[-2]))
        return path
    for u in near:
        if len(near[u]) != 2:
            for v in near[u]:
                p = follow(u, v, lambda x: len(near[x]) != 2)
                used |= {frozenset(e) for e in zip(p, p[1:])}
                lines.add(tuple(min(p, p[::-1], key=lambda q: q[:2])))
    for u in sorted(near):
        for v in sorted(near[u]):
            if frozenset((u, v)) not in used:
                p = follow(u, v, lambda x: x == u)
                used |= {frozenset(e) for e in zip(p, p[1:])}
                lines.add(tuple(min(p, p[::-1], key=lambda q: q[:2])))
    return lines


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_random_graphs(spark, seed):
    dice, rows, want = random.Random(seed), [], {}
    for k in ("a", "b", "c"):
        nodes = dice.sample(range(10_000), 260)
        graph = {tuple(sorted(e)) for e in zip(nodes[:100], nodes[1:100])}                       # one long line
        graph |= {tuple(sorted(e)) for e in zip(nodes[100:140], nodes[101:140] + nodes[100:101])}  # one cycle
        graph |= {tuple(sorted((nodes[140 + 3 * i + a], nodes[140 + 3 * i + b]))) for i in range(5) for a, b in ((0, 1), (1, 2), (0, 2))}
        graph |= {tuple(sorted(dice.sample(nodes[160:], 2))) for _ in range(90)} if k != "c" else set()
        graph |= {tuple(sorted((nodes[0], nodes[5])))} if k == "b" else set()                    # a loop at a junction
        rows += [(k, u, v) for u, v in graph]
        want[k] = walk(graph)
    out = C.ordered_lines(spark.createDataFrame(rows, "key string, u long, v long"), ["key"])
    got = {}
    for r in C.line_vertices(out, ["key"]).collect():
        got.setdefault((r.key, r.first, r.second), []).append((r.pos, r.node, r.along, r.behind, r.ahead))
    lines = {}
    for (k, first, second), at in got.items():
        at.sort()
        assert [p for p, *_ in at] == list(range(len(at))) and [a for _, _, a, _, _ in at] == [float(p) for p in range(len(at))]
        path = tuple(n for _, n, *_ in at)
        assert path[:2] == (first, second) and [b for *_, b, _ in at] == [None, *path[:-1]] and [a for *_, a in at] == [*path[1:], None]
        lines.setdefault(k, set()).add(path)
    assert lines == want
    for r in out.collect():
        assert r.total == float(r.edges)


def test_no_edges(spark):
    assert C.ordered_lines(spark.createDataFrame([], "key string, u long, v long"), ["key"]).count() == 0
