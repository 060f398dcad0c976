"""Packing: length buckets with optimal boundaries and token-budget batches inside each."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import running_total, word_count, word_pieces


def best_boundaries(lengths, counts, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges with the least padding in all.

    Dynamic programming over the sorted distinct lengths: ``cost[k][j]`` is the least padding of
    the first j lengths in k ranges, a range being padded to its longest member.  The best cut
    never moves back as j grows, so each layer is solved by halving: the middle j is scanned in
    full and bounds the cuts on both sides.
    """
    order = np.argsort(np.asarray(lengths))
    size = np.asarray(lengths, np.int64)[order]
    weight = np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(weight)])
    words = np.concatenate([[0], np.cumsum(weight * size)])
    layers = min(buckets, n)
    cost = size * rows[1:] - words[1:]
    cost = np.concatenate([[0], cost])
    cuts = np.zeros((layers, n + 1), np.int64)
    for k in range(1, layers):
        fresh = cost.copy()
        spans = [(1, n, 0, n - 1)]
        while spans:
            lo, hi, left, right = spans.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            tried = cost[i] + size[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i])
            best = int(np.argmin(tried))
            fresh[j], cuts[k, j] = tried[best], i[best]
            spans += [(lo, j - 1, left, int(i[best])), (j + 1, hi, int(i[best]), right)]
        cost = fresh
    ends, j = [], n
    for k in range(layers - 1, -1, -1):
        ends.append(int(size[j - 1]))
        j = int(cuts[k, j])
        if j == 0:
            break
    return sorted(set(ends))


def pieces(docs: DataFrame, longest: int, with_text: bool = False) -> DataFrame:
    """doc_id, piece, first, tokens (and text): documents of more than ``longest`` words come in
    consecutive pieces; a document without words (or with a null text) is one piece of none."""
    n = F.greatest(F.lit(1), F.ceil(F.col("_words") / longest)).cast("int")
    base = docs.select("doc_id", "text", word_count("text").alias("_words"), F.xxhash64("doc_id", "text").alias("_doc"))
    if with_text:
        parts = word_pieces(F.col("text"))
        base = base.withColumn("_split", F.explode(F.array(F.when(F.col("_words") > longest, parts))))  # split once per document
        slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(
            F.slice(F.col("_split"), i * longest + 1, F.when(i == n - 1, F.size("_split") - i * longest).otherwise(F.lit(longest))), ""))
        cut_up = F.when(F.col("_words") <= longest, F.array("text")).otherwise(slices)
        out = base.select("doc_id", "_words", "_doc", F.posexplode(cut_up).alias("piece", "text"))
    else:
        out = base.select("doc_id", "_words", "_doc", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    first = (F.col("piece") * F.lit(longest)).cast("long")
    return out.select("doc_id", "piece", first.alias("first"), F.least(F.lit(longest).cast("long"), F.col("_words") - first).alias("tokens"), "_doc",
                      *(["text"] if with_text else []))


def pack(docs: DataFrame, buckets: int = 16, longest: int = 4096, budget: int = 65536, seed: int = 0, with_text: bool = False) -> DataFrame:
    """doc_id, piece, first, tokens, bucket, width, batch, slot (and text).

    ``width`` is the length all rows of the bucket are padded to; a batch of a bucket holds
    max(1, budget // width) rows.  Batches are numbered from 0 in each bucket and filled in seeded order,
    all full but a bucket's last.  The histogram has at most ``longest`` + 1 rows (longer
    documents come in pieces), so it is the one thing that reaches the driver.  Every document
    is in the result; an empty table gives no rows; equal rows are interchangeable.
    """
    rows = pieces(docs, longest, with_text)
    histogram = pieces(docs, longest).groupBy("tokens").agg(F.count("*").alias("n")).collect()  # at most longest + 1 rows
    ends = best_boundaries([r["tokens"] for r in histogram], [r["n"] for r in histogram], buckets) or [0]
    table = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("tokens") > e).cast("int")
    rows = rows.withColumn("bucket", bucket).withColumn("_hash", F.xxhash64(F.lit(seed), "_doc", "piece")).withColumn("_one", F.lit(1).cast("long"))
    placed = running_total(rows, "bucket", "_hash", "_one", "_n").withColumn("width", F.element_at(table, F.col("bucket") + 1))
    room = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(width, 1)"))
    placed = placed.withColumn("_room", room)
    return placed.select("doc_id", "piece", "first", "tokens", "bucket", "width", F.expr("_n div _room").alias("batch"),
                         (F.col("_n") % F.col("_room")).cast("int").alias("slot"), *(["text"] if with_text else []))
