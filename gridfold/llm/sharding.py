"""Shards and slots from a keyed permutation of global row numbers.

Row ``i`` of ``n`` goes to position ``p = permute(i)``; its shard is ``p % shards`` and its slot
``p // shards``.  Both are computable from ``i`` alone, and ``row_at`` is the way back, so a
reader can find any (shard, slot) without an index.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import mix, numbered

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _round(left: np.ndarray, right: np.ndarray, a: int, b: int, j: int, seed: int, back: bool):
    """One Feistel round: one half is shifted by a keyed function of the other, modulo its range."""
    source, goal, size = (right, left, a) if j % 2 == 0 else (left, right, b)
    step = mix(source, (seed * 0x9E3779B97F4A7C15 + (j + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)) % np.uint64(size)
    moved = (goal + (np.uint64(size) - step if back else step)) % np.uint64(size)
    return (moved, right) if j % 2 == 0 else (left, moved)


def permute(rows, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 (its inverse with ``back``).

    The network permutes a grid a x b of at least n cells; a result beyond n walks on along its
    cycle until it falls inside, which keeps the whole a permutation of 0..n-1.
    """
    out = np.asarray(rows, np.int64).astype(np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    a, b = _halves(n)
    todo = np.arange(len(out))
    while len(todo):
        right, left = np.divmod(out[todo], np.uint64(a))
        for j in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = _round(left, right, a, b, j, seed, back)
        out[todo] = right * np.uint64(a) + left
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that lies in a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def place(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` and ``slot``; every shard gets n/shards rows, rounded down or up.

    Global row numbers follow ``order`` (nulls first).  Rows equal in all of ``order`` may swap
    numbers, so list enough columns to tell rows apart.  An empty table stays empty.  Columns
    named ``shard`` or ``slot`` are replaced.
    """
    rows = numbered(df.drop("shard", "slot"), order, "_row")
    n = int(rows.agg(F.count("*").alias("n")).first()["n"])

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return (rows.withColumn("_p", position("_row")).withColumn("shard", (F.col("_p") % shards).cast("int"))
            .withColumn("slot", F.expr(f"_p div {shards}")).drop("_p", "_row"))


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Shards of a document table by the law of equal counts.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null text:
    that of no bytes, 0), law, shard, slot, grown_shard (null under this law).  Documents are
    numbered by doc_id, checksum, size and a hash of the text; equal rows are interchangeable.
    Only these columns are read; others, and null ids, do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_h"))
    out = place(slim, ["doc_id", "text_crc32", "size", "_h"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
