"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.session import cut

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BLOCK_BITS = 12  # a key is worked on in 2**12 blocks of its hash order


def word_count(text: str) -> Column:
    """Number of words (maximal runs without ASCII white space); a null text has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def word_pieces(text: Column) -> Column:
    """The text cut before each white space that follows a word: piece i holds word i with the
    white space in front of it, so joined pieces give the text back (a tail of white space may
    be one more piece)."""
    return F.split(text, rf"(?<=[^{SPACE}])(?=[{SPACE}])")


def running_total(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same key that come before in the order of
    the long hash column ``order``; rows with equal hashes come in any order.

    Rows are summed inside (key, leading bits of the hash) and block sums are added, so a key
    with most of the rows is spread over 4096 groups.  ``key`` must not be null.
    """
    df = df.withColumn("_blk", F.shiftright(order, 64 - BLOCK_BITS))
    sums = df.groupBy(key, "_blk").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")
    offsets = sums.select(key, "_blk", before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return (df.withColumn("_inside", inside).join(offsets, [key, "_blk"])
            .withColumn(out, F.col("_before") + F.col("_inside")).drop("_blk", "_before", "_inside"))


def numbered(df: DataFrame, order: list[str], out: str, value: str | None = None) -> DataFrame:
    """Global row numbers from 0 in the order of ``order`` (nulls first), or the sums of ``value``
    over all rows before, without one task for all rows: a range sort is written once, and
    totals of its partitions are added up.

    Rows equal in ``order`` are told apart by their place in the input, so a value held by most
    rows is still cut into many ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys, "_place").sortWithinPartitions(*keys, "_place")
    ranged = cut(ranged.drop("_place")).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    if value:
        inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
        sums = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
        starts = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))  # as many rows as partitions
        return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(out, F.col("_in") + F.col("_shift")).drop("_part", "_at", "_in", "_shift")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # as many rows as partitions
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows (null: empty text)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int):
    """Ranges of rows holding at most ``most`` bytes together (a longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = 0xD6E8FEB86659FD93
UNDO = pow(ODD, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64 for i < n, kept for the next call."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", ODD), ("down", UNDO)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x + np.uint64(seed & (2**64 - 1))) if seed else x.copy()
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 0xE7037ED1A0B428DB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word of the buffer; no word reaches over a row's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[raw]
    first = ~space
    last = ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = ~space[inner]        # a row's first byte starts a word, and its last byte ends one
    last[inner - 1] = ~space[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in reading order, and how many words each row has.

    A word's hash is a polynomial in its bytes modulo 2**64, from one running sum over the
    buffer, then mixed; A-Z count as a-z if ``lower``.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    starts, ends = word_bounds(raw, offsets)
    ends = ends - 1
    up, down = _powers(len(raw))
    sums = np.cumsum((LOWER[raw] if lower else raw).astype(np.uint64) * up, dtype=np.uint64)
    head = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    words = (sums[ends] - head) * down[starts]
    words = mix(words ^ (ends - starts + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return words, np.diff(np.searchsorted(starts, offsets))
