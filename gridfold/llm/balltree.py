"""Exact inner-product search: a ball tree per shard, branch and bound, one threshold per query.

Candidates are dealt into shards of about SHARD rows; a task builds each shard's tree once and
stores it as one row.  A first pass scores every query against one bounded seed shard; the k-th
best score found there is a true lower bound and is sent along to every other shard; a task that
meets a query in several shards carries the best k-th score from one to the next.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.session import cut

SHARD, LEAF, BLOCK = 8192, 64, 1024
SAFE = float(2**52)
LEAST = np.iinfo(np.int64).min


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """(row order, nodes (first, past last, left, right), centres, radii): the rows of a node are
    cut at the median of their projection on the line between two far points."""
    order = np.arange(len(vectors))
    nodes, centres, radii = [], [], []
    todo = [(0, len(vectors), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = vectors[order[a:b]]
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([a, b, -1, -1])
        centres.append(centre)
        radii.append(far.max())
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a > LEAF and far.max() > 0:
            one = own[int(far.argmax())]
            two = own[int(((own - one) ** 2).sum(axis=1).argmax())]
            middle = (b - a) // 2
            rank = np.argpartition((own * (two - one)).sum(axis=1), middle)
            order[a:b] = order[a:b][rank]
            todo += [(a, a + middle, me, 0), (a + middle, b, me, 1)]
    return order, [tuple(x) for x in nodes], np.array(centres), np.array(radii)


def scores_of(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, by floats where they are exact."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < SAFE:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


def search(tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard that reach ``floor``; nodes by falling upper bound.

    Rows and ids are in tree order.  The bound of a node is query . centre + |query| radius, widened
    by a hair for rounding; a node goes only if even that is below the current k-th score.
    """
    nodes, centres, radii = tree
    q = query.astype(np.float64)
    length = float(np.sqrt((q * q).sum()))
    bound = centres @ q + length * radii
    bound = bound + 1e-9 * (np.abs(bound) + length * (radii + np.sqrt((centres * centres).sum(axis=1)))) + 1e-6
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
    queue = [(-bound[0], 0)]
    while queue:
        top, i = heapq.heappop(queue)
        least = best[0][0] if len(best) == k else None
        least = floor if least is None else least if floor is None else max(least, floor)
        if least is not None and -top < least:
            break
        a, b, left, right = nodes[i]
        if left >= 0:
            heapq.heappush(queue, (-bound[left], left))
            heapq.heappush(queue, (-bound[right], right))
            continue
        got = scores_of(vectors[a:b], query)
        ok = np.flatnonzero((got >= least) & (ids[a:b] != own)) if least is not None else np.flatnonzero(ids[a:b] != own)
        for j in ok.tolist():
            item = (int(got[j]), -int(ids[a + j]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(s, -i) for s, i in best]


def in_reach(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows (ids ascending) can be in any answer: of equal vectors those of the k + 1 smallest distinct
    ids (one may be the query's own), and of an id's repeated rows at most k.  Whatever else ranks
    behind k of these, for every query."""
    _, same = np.unique(v, axis=0, return_inverse=True)
    rows = pd.DataFrame({"same": same.ravel(), "id": ids})
    row = rows.groupby(["same", "id"]).cumcount().to_numpy()
    new = pd.Series((row == 0).astype(np.int64))
    distinct = new.groupby(rows["same"]).cumsum().to_numpy()  # of ids, up to this row
    return (distinct <= k + 1) & (row < k)


def quantised(table: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * component), each component as double.  Rows without id or vector, and vectors
    with null or non-finite components, are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (table.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))


def _matrix(rows: pd.Series, wide: int) -> np.ndarray:
    out = np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the
    smaller id.

    ``vectors`` and ``queries`` have vec_id, v (array<long>); a query is not its own candidate.
    Shorter vectors count as filled up with zeros.  Equal rows stay separate candidates; equal
    queries are asked once.  Scores must fit 64 bits.
    """
    vectors, queries = cut(vectors), cut(queries.distinct())
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("wide")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("wide")).first()
    wide = max(facts["wide"] or 0, asked["wide"] or 0, 1)
    shards, blocks = max(1, -(-facts["n"] // SHARD)), max(1, -(-asked["n"] // BLOCK))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        v = _matrix(group["v"], wide)
        stay = in_reach(v, group["vec_id"].to_numpy(np.int64), k)
        group, v = group[stay], v[stay]
        order, nodes, centres, radii = build_tree(v.astype(np.float64))
        return pd.DataFrame({"shard": [key[0]], "n": [len(v)], "ids": [group["vec_id"].to_numpy(np.int64)[order].tobytes()], "rows": [v[order].tobytes()],
                             "nodes": [np.array(nodes, np.int64).tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "asked": [group["vec_id"].to_numpy(np.int64).tobytes()], "what": [_matrix(group["v"], wide).tobytes()]})

    salt = F.monotonically_increasing_id()
    trees = cut(vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", salt), F.lit(shards)).cast("int")).groupBy("shard")
                .applyInPandas(build, "shard int, n long, ids binary, rows binary, nodes binary, centres binary, radii binary"))
    asks = cut(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", salt), F.lit(blocks)).cast("int")).groupBy("block")
               .applyInPandas(gather, "block int, asked binary, what binary"))
    first = trees.agg(F.min("shard").alias("s")).first()["s"]

    def run(batches):
        shared: dict[int, np.ndarray] = {}  # per block, the best k-th scores known to this task
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64).reshape(-1, wide)
                tree = ([tuple(x) for x in np.frombuffer(r.nodes, np.int64).reshape(-1, 4).tolist()], np.frombuffer(r.centres).reshape(-1, wide), np.frombuffer(r.radii))
                asked, what = np.frombuffer(r.asked, np.int64), np.frombuffer(r.what, np.int64).reshape(-1, wide)
                floors = np.frombuffer(r.floors, np.int64) if isinstance(r.floors, (bytes, bytearray)) else None
                known = shared.setdefault(r.block, np.full(len(asked), LEAST) if floors is None else floors.copy())
                out = []
                for i, q in enumerate(asked.tolist()):
                    best = search(tree, rows, ids, what[i], q, k, None if known[i] == LEAST else int(known[i]))
                    if len(best) == k:
                        known[i] = max(known[i], min(best)[0])
                    out += [(r.block, i, q, v, s) for s, v in best]
                yield pd.DataFrame(out, columns=["block", "place", "query_id", "vec_id", "score"])

    def floors(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].iloc[0])
        low = np.full(n, LEAST)
        got = group.dropna(subset=["place"])
        low[got["place"].to_numpy(np.int64)] = got["low"].to_numpy(np.int64)
        return pd.DataFrame({"block": [key[0]], "floors": [low.tobytes()]})

    schema = "block int, place int, query_id long, vec_id long, score long"
    if first is None or not asked["n"]:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    # one tree of about SHARD rows goes to every query block; a literal key would be planned as a product of all partitions
    one = F.broadcast(trees.where(F.col("shard") == first))
    seed = cut(asks.withColumn("shard", (F.col("block") * 0 + first).cast("int")).join(one, "shard").withColumn("floors", F.lit(None).cast("binary")).mapInPandas(run, schema))
    tenth = seed.groupBy("block", "place").agg(F.count("*").alias("c"), F.min("score").alias("low")).where(F.col("c") >= k)
    low = (asks.select("block", F.expr("octet_length(asked) div 8").alias("n")).join(tenth, "block", "left")
           .groupBy("block").applyInPandas(floors, "block int, floors binary"))
    rest = asks.join(low, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != first)
    more = rest.repartition(F.col("block"), F.col("shard")).join(trees, "shard").mapInPandas(run, schema)
    every = seed.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
