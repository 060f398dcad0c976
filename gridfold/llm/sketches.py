"""Near copies by SetSketch: mergeable registers, bands of register values, joint likelihood, exact check.

A document's set is its distinct shingles of words.  Register i holds the exponentially spaced,
truncated minimum of one hash over the set; two registers agree about as often as the sets
overlap.  Registers of a union are the larger of both, so sketches merge.
"""
from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER, mix, numbered, row_chunks, texts_of, word_bounds
from gridfold.session import cut, scratch

BANDS, ROWS = 41, 5            # a link of similarity 0.8 shares no band with probability 9e-8
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
SLACK = 0.13                   # an estimate this far below the threshold rules a pair out (over four deviations)
FEW = 32                       # documents in a band that are compared pair by pair
LOOSE, ROUNDS = 0.5, 3         # agreeing registers that join a document with the hub of a wider band; hubs that it tries
CHUNK = 1_500_000              # bytes of text worked on at once
BLOCK, EXTRA = 600_000, 1_000  # shingles in a block of documents compared with each other; what a document counts besides

_rng = np.random.Generator(np.random.PCG64(20))
FACTORS = _rng.integers(0, 2**31, REGISTERS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def word_digests(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2 digests (64 bits) of all words in reading order, A-Z as a-z, and how many each row has;
    distinct words are hashed once."""
    starts, ends = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = LOWER[raw]
    # words with what follows them up to the next word, then cut back to the word
    bounds = np.stack([starts, ends], axis=1).ravel()
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(low.tobytes())])
    coded = runs.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
    digests = np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    return digests[coded.indices.to_numpy()], np.diff(np.searchsorted(starts, offsets))


def shingle_words(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words, not as hashes."""
    found = text.encode().translate(bytes(LOWER)).split()  # bytes split at ASCII white space alone
    if len(found) <= words:
        return {tuple(found)} if found else set()
    return set(zip(*[found[i:] for i in range(words)]))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all rows, row after row, and how many each row has.

    A row with fewer words than a shingle takes has its whole sequence as the one shingle; a row
    without words has none.
    """
    hashes, count = word_digests(raw, offsets)
    n = len(count)
    kept = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not len(hashes):
        return np.zeros(0, np.uint64), kept
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(n), kept)
    at = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept) + first[row]
    size = np.minimum(count, words)[row]
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        held = size > k
        value[held] = mix(value[held] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[held] + k])
    value = mix(value + size.astype(np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.bincount(row[fresh], minlength=n)


def set_registers(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of sets laid one after the other; empty sets: zeros."""
    out = np.zeros((len(count), REGISTERS), np.uint16)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    starts = (np.cumsum(count) - count)[full]
    x = (values >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(x)
    least = np.empty((len(full), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        np.multiply(x, FACTORS[i], out=work)
        least[:, i] = np.minimum.reduceat(work, starts)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands (rows x BANDS)."""
    grid = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grid.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, k])
    return key.view(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches, given how often registers are higher,
    lower and equal, and both set sizes."""
    higher, lower = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - higher - lower
    u = na / (na + nb)
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j):
        p, q = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return higher * np.log(p + tiny) + lower * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        left, right = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        better = fit(left) > fit(right)
        hi, lo = np.where(better, right, hi), np.where(better, lo, left)
    return (lo + hi) / 2


def sketch_documents(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n (set size), s1, s2 (128 bits of the set), registers; null texts have empty sets."""
    def work(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                values, count = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                ends = np.cumsum(count)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, seed), dtype=np.uint64)]) for seed in (11, 12)]
                parts = [(x[ends] - x[ends - count]).view(np.int64) for x in sums]
                rows = set_registers(values, count)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), *map(pa.array, parts),
                                                  pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "n", "s1", "s2", "registers"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, s1 long, s2 long, registers binary")


def _bands(reps: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                registers = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(registers)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["rep", "bucket"])
    return reps.select("rep", "registers").mapInArrow(work, "rep long, bucket long")


def _agreement(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``u, v, same``: the share of equal registers of every pair."""
    def work(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1))], ["u", "v", "same"])
    both = pairs.join(held.select(F.col("rep").alias("u"), F.col("registers").alias("_a")), "u").join(held.select(F.col("rep").alias("v"), F.col("registers").alias("_b")), "v")
    return both.select("u", "v", "_a", "_b").mapInArrow(work, "u long, v long, same double")


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect any two representatives that share a band and may be similar enough.

    Chance bands would chain unrelated documents to clusters that outgrow the input, so only pairs are joined whose registers
    agree.  Two that are similar agree in ``least`` of them; in a band of at most FEW documents that is asked of every pair.
    The smallest of a wider band is its hub: when one of two similar documents agrees with it in LOOSE + 1 - ``least``,
    the other does in LOOSE, so both are joined with the hub and the first may leave.  The others go on to the
    next hub, ROUNDS times; a band that is still wide is joined as it is.
    """
    least = percent / 100 - SLACK
    loose = min(LOOSE, least)
    band = Window.partitionBy("bucket")

    def shared(rows):  # ``n`` in the band, ``u`` the hub; one pass, no join of a band with itself
        return cut(rows.select("bucket", "rep", F.count("*").over(band).alias("n"), F.min("rep").over(band).alias("u")).where("n > 1"))
    rows = shared(_bands(reps))
    held = cut(reps.select("rep", "registers").join(rows.select("rep").distinct(), "rep", "left_semi"))
    out, small = [], [rows.where(F.col("n") <= FEW)]
    for last in [False] * ROUNDS + [True]:
        starred = rows.where((F.col("n") > FEW) & (F.col("u") != F.col("rep"))).select("bucket", "u", F.col("rep").alias("v"))
        pairs = starred.select("u", "v").distinct()
        if last:
            out.append(pairs)
            break
        same = cut(_agreement(pairs, held))
        out.append(same.where(F.col("same") >= loose).select("u", "v"))
        rest = starred.join(same.where(F.col("same") < loose + 1 - least).select("u", "v"), ["u", "v"], "left_semi").select("bucket", F.col("v").alias("rep"))
        rows = shared(rest)
        small.append(rows.where(F.col("n") <= FEW))
        if rows.where(F.col("n") > FEW).isEmpty():
            break
    few = reduce(DataFrame.unionByName, small).select("bucket", "rep")
    pairs = few.withColumnRenamed("rep", "u").join(few.withColumnRenamed("rep", "v"), "bucket").where("u < v").select("u", "v").distinct()
    out.append(_agreement(pairs, held).where(F.col("same") >= least).select("u", "v"))
    return cut(reduce(DataFrame.unionByName, out).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table (u, v): the smallest node it is joined with.

    A round points each node at its smallest neighbour, doubles the pointers until they are flat
    and rewrites the edges by the roots.  A star or a path that rises is one tree and done in one round;
    a hub is one grouped minimum.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    graph, steps = cut(both.where("u <> v").distinct()), []
    while not graph.isEmpty():
        step = graph.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        flat = False
        while not flat:
            for _ in range(2):
                far = step.select(F.col("node").alias("root"), F.col("root").alias("_far"))
                step = step.select("node", "root").join(far, "root").select("node", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("moved"))
            step = cut(step)
            flat = step.where("moved").isEmpty()
        step = step.drop("moved")
        steps.append(step)
        ends = graph.join(step.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(step.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        graph = cut(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    if not steps:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return cut(out) if len(steps) > 1 else out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def compare_block(rows: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links of one block (node, cluster, root, side, text), as a forest.

    Documents of the same cluster and different root are compared, except two on the same side
    other than 0.  The likeliest pairs come first and pairs already joined are passed over,
    so what comes out is enough for the components and nothing more.
    """
    rows = rows.sort_values(["cluster", "node"], kind="stable").reset_index(drop=True)
    raw, offsets = texts_of(pa.array(rows["text"], pa.large_string()))
    values, count = shingle_sets(raw, offsets, words)
    registers = set_registers(values, count)
    ends = np.cumsum(count)
    cluster, side = rows["cluster"].to_numpy(), rows["side"].to_numpy()
    node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
    _, group = np.unique(root, return_inverse=True)
    parent = list(range(int(group.max()) + 1))
    pairs, loose = [], min(LOOSE, percent / 100 - SLACK)
    edge = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        for i in range(lo, hi - 1):
            j = np.arange(i + 1, hi)
            small, large = np.minimum(count[i], count[j]), np.maximum(count[i], count[j])
            ok = (group[j] != group[i]) & (100 * small >= percent * large) & (small > 0)
            ok &= (side[j] != side[i]) | (side[i] == 0)
            j = j[ok]
            j = j[(registers[j] == registers[i]).sum(axis=1) >= loose * REGISTERS]  # far cheaper than the likelihood
            if len(j):
                near = likely_similarity(np.broadcast_to(registers[i], (len(j), REGISTERS)), registers[j], np.full(len(j), count[i]).astype(float), count[j].astype(float))
                keep = near >= percent / 100 - SLACK
                pairs.append((near[keep], np.full(int(keep.sum()), i), j[keep]))
    out = []
    if pairs:
        near, left, right = (np.concatenate(x) for x in zip(*pairs))
        for k in np.argsort(-near, kind="stable"):
            i, j = int(left[k]), int(right[k])
            a, b = _find(parent, int(group[i])), _find(parent, int(group[j]))
            if a == b:
                continue
            one, other = values[ends[i] - count[i]:ends[i]], values[ends[j] - count[j]:ends[j]]
            both = len(np.intersect1d(one, other, assume_unique=True))
            if 100 * both < percent * (len(one) + len(other) - both):
                continue
            first, second = shingle_words(rows["text"].iat[i], words), shingle_words(rows["text"].iat[j], words)  # hashes propose, words decide
            both = len(first & second)
            if 100 * both >= percent * (len(first) + len(second) - both):
                parent[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return pd.DataFrame(out, columns=["u", "v"])


def _blocks(members: DataFrame, order: list[str]) -> DataFrame:
    """Add ``block``: consecutive members in ``order`` of about BLOCK shingles together."""
    return members.withColumn("_w", F.col("n") + EXTRA).transform(lambda d: numbered(d, order, "_cum", "_w")).withColumn("block", F.expr(f"_cum div {BLOCK}")).drop("_cum", "_w")


def near_copies(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Documents whose sets have 100 * intersection >= ``percent`` * union are linked; component_id is
    the smallest doc_id reachable, and only that document is kept.  Empty sets (no words, null
    text) link with nothing.  Rows with the same doc_id are one node; rows without one link with nothing,
    have no component and are kept.

    Equal sets are one representative from the start.  Representatives that share a band and may be
    similar belong to one candidate cluster; clusters are laid out in blocks of bounded size, and every pair of a
    cluster is compared: inside blocks, then each block with its cluster's first, then what still
    has different roots.  A pure block pair of one root is never looked at, so a huge group
    of copies costs its own size.
    """
    spark = docs.sparkSession
    sk = cut(sketch_documents(docs, words))
    linked = sk.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut(linked.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    reps = linked.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "n", "doc_id"], "left_semi").withColumnRenamed("doc_id", "rep")
    edges = candidate_edges(reps, percent)
    links = _link(spark, docs, classes, edges, words, percent)
    # a doc_id with several texts stands in several classes and joins them
    ids = linked.select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("doc_id", "rep")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("_top")).where("u < _top").drop("_top")
    links = links.unionByName(ids.join(several, "doc_id").where("u <> rep").select("u", F.col("rep").alias("v")))
    roots = components(links).withColumnRenamed("node", "rep")
    named = classes.join(roots, "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("component_id"))
    out = sk.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _link(spark, docs: DataFrame, classes: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that join what is similar; ``edges`` join representatives that share a band."""
    compare = _typed(lambda rows: compare_block(rows, words, percent))
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"))
    clusters = components(edges).select(F.col("root").alias("cluster"), "node")
    placed = cut(_blocks(clusters.join(sizes, "node"), ["cluster", "node"]))
    spans = placed.groupBy("cluster").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    placed = placed.join(spans, "cluster")
    path = scratch(spark, "near-copies")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null and text is not null")
    texts.join(placed, "node").select("node", "cluster", "n", "block", "lo", "hi", "text").write.parquet(path)
    held = spark.read.parquet(path)
    columns = ["node", "cluster", "root", "side", "text"]
    # a block among itself, and with the members of its clusters that lie in the cluster's first block
    tasks = F.when(F.col("block") == F.col("lo"), F.sequence("lo", "hi")).otherwise(F.array("block"))
    first = held.withColumn("task", F.explode(tasks)).withColumn("side", F.when(F.col("task") == F.col("block"), 0).otherwise(1)).withColumn("root", F.col("node"))
    links = cut(first.select("task", *columns).groupBy("task").applyInPandas(compare, "u long, v long"))
    wide = placed.where("lo < hi").select("node", "cluster", "n")
    if wide.isEmpty():
        return links
    wide = wide.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(_blocks(wide, ["cluster", "root", "node"]))
    parts = rooted.groupBy("cluster", "block").agg(F.min("root").alias("a"), F.max("root").alias("z"))
    parts = parts.select("cluster", "block", F.when(F.col("a") == F.col("z"), F.col("a")).alias("pure"))
    many = parts.where("pure is not null").groupBy("cluster", "pure").agg(F.count("*").alias("c"))
    main = many.groupBy("cluster").agg(F.max(F.struct("c", "pure"))["pure"].alias("main"))
    parts = parts.join(main, "cluster", "left").withColumn("odd", ~F.coalesce(F.col("pure") == F.col("main"), F.lit(False)))
    odd = parts.where("odd").select("cluster", F.col("block").alias("one"), F.col("pure").alias("p1"))
    pairs = odd.join(parts.select("cluster", F.col("block").alias("two"), F.col("pure").alias("p2"), F.col("odd").alias("odd2")), "cluster")
    pairs = pairs.where("(not odd2 or one <= two) and not coalesce(p1 = p2, false)").select("cluster", F.least("one", "two").alias("i"), F.greatest("one", "two").alias("j"))
    pairs = cut(pairs)
    left = pairs.join(rooted.withColumnRenamed("block", "i"), ["cluster", "i"]).withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(1))
    right = pairs.where("i < j").join(rooted.withColumnRenamed("block", "j"), ["cluster", "j"]).withColumn("side", F.lit(2))
    last = left.unionByName(right, allowMissingColumns=True).select("i", "j", "node", "cluster", "root", "side")
    rest = held.where("lo < hi").select("node", "text").join(last, "node")
    return links.unionByName(cut(rest.select("cluster", "i", "j", "node", "root", "side", "text").groupBy("cluster", "i", "j").applyInPandas(compare, "u long, v long")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a kept one; columns as they were.

    A row is known by its id, and where an id repeats by id and text together, so that different
    texts under one id are judged each by itself; of rows equal in both one stays.  Rows
    without an id link with nothing and stay.  Of a group the smallest id stays, ids that repeat last.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_c"))
    twice = cut(ids.where("_c > 1").select("doc_id"))
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long"))
    if not twice.isEmpty():
        digest = F.coalesce(F.sha2("text", 256), F.lit("-"))
        many = docs.join(twice, "doc_id", "left_semi").withColumn("_digest", digest).dropDuplicates(["doc_id", "_digest"])
        top = docs.agg(F.max("doc_id").cast("long")).first()[0]
        names = numbered(many.select("doc_id", "_digest"), ["doc_id", "_digest"], "_key").withColumn("_key", F.col("_key") + F.lit(top + 1))
        keyed = keyed.join(twice, "doc_id", "left_anti").select(*docs.columns, "_key").unionByName(many.join(names, ["doc_id", "_digest"]).select(*docs.columns, "_key"))
        keyed = cut(keyed)
    gone = near_copies(keyed.select(F.col("_key").alias("doc_id"), "text"), words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def _typed(fn):
    def typed(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows)
    return typed

