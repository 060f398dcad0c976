"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a
hashed linear scorer trained on the posterior labels.  No given label is used."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import hash_words, row_chunks, texts_of

CHUNK = 1_500_000
SAMPLE = 2000      # documents the scorer is trained on, at most
FALSE_ALARM = 0.004
FEW = 8
BINS = 1 << 12     # hashed features
CLASSES = np.full(256, 4, np.uint8)  # other signs
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[97:123] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5  # punctuation of prose
CLASSES[128:] = 6
LABELLERS = ("marks", "capitals", "echo", "few_words", "shouts", "cells", "varied", "cased", "sentences")


def _shares(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, per row: counts of words, repeats, distinct words, classes of bytes."""
    n = len(offsets) - 1
    words, count = hash_words(raw, offsets, lower=False)
    row = np.repeat(np.arange(n), count)
    kind = CLASSES[raw] if len(raw) else np.zeros(0, np.uint8)
    per = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets]).astype(float)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    fresh = np.ones(len(words), bool)
    if len(words):
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    after = np.zeros(len(raw), bool)
    after[1:] = kind[:-1] != 0
    stop = np.isin(raw, [46, 63, 33]) if len(raw) else np.zeros(0, bool)
    ending = np.zeros(len(raw), bool)
    ending[:-1] = stop[:-1] & (kind[1:] == 0)
    if n:
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ending[last] = stop[last]
    double = np.zeros(len(raw), bool)
    double[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    total = np.maximum(count, 1).astype(float)
    letters = np.maximum(per((kind == 1) | (kind == 2)), 1)
    return {"words": count.astype(float), "marks": per((kind == 4) & (raw != 124)) / total, "bars": per(raw == 124) / total, "capitals": per(kind == 2) / letters,
            "echo": np.bincount(row[again], minlength=n) / total, "distinct": np.bincount(row[order][fresh], minlength=n) / total,
            "ends": per(ending) / total, "shouts": per(double) / total}


def votes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes (rows x labellers): -1 poor, 1 good, 0 abstains.

    Six labellers know one kind of poor text each and say nothing otherwise; three know a sign
    of good prose.  Texts of few words leave most of them silent.
    """
    s = _shares(raw, offsets)
    long = s["words"] >= 20
    poor = lambda bad: -bad.astype(np.int8)
    good = lambda ok: ok.astype(np.int8)
    some = s["words"] > 0
    return np.stack([
        poor(some & (s["marks"] > 0.3)), poor(some & (s["capitals"] > 0.5) & (s["words"] >= 4)), poor(long & (s["echo"] > 0.2)),
        poor(long & (s["distinct"] < 0.3 * np.minimum(1, (2000 / np.maximum(s["words"], 1)) ** 0.3))), poor(some & (s["shouts"] > 0.3)), poor(some & (s["bars"] > 0.3)),
        good(some & (s["distinct"] > 0.45) & (s["echo"] < 0.1)), good(some & (s["capitals"] < 0.35)), good(some & (s["ends"] > 0.01) & ((s["ends"] <= 0.35) | (s["words"] < 12)) & (s["marks"] < 0.1) & (s["bars"] < 0.1))], axis=1)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features in reading order: (row, bin, weight), a row's weights summing to 1 for its
    byte trigrams and to 1 for the shapes of its words (classes of both ends, length, whether the
    word repeats the one before)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    grams = np.maximum(size - 2, 0)
    row = np.repeat(np.arange(n), grams)
    at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams) + offsets[:-1][row]
    wide = raw.astype(np.uint32)
    code = (wide[at] << np.uint32(16)) | (wide[at + 1] << np.uint32(8)) | wide[at + 2] if len(at) else np.zeros(0, np.uint32)
    half = BINS // 2
    bins = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) % half
    words, count = hash_words(raw, offsets, lower=False)
    owner = np.repeat(np.arange(n), count)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    space = CLASSES[raw] == 0 if len(raw) else np.zeros(0, bool)
    first = ~space
    first[1:] &= space[:-1]
    first[offsets[:-1][size > 0]] = ~space[offsets[:-1][size > 0]]
    last = ~space
    last[:-1] &= space[1:]
    last[offsets[1:][size > 0] - 1] = ~space[offsets[1:][size > 0] - 1]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    shape = CLASSES[raw[a]].astype(np.int64) * 7 + CLASSES[raw[z]]
    before = CLASSES[raw[np.maximum(z - 1, a)]].astype(np.int64)
    shape = ((shape * 7 + before) * 8 + np.minimum((z - a) // 3, 7)) * 2 + again
    shapes = half + (shape * 40503 % 65521) % half
    return (np.concatenate([row, owner]), np.concatenate([bins, shapes]),
            np.concatenate([1.0 / np.maximum(grams, 1)[row], 1.0 / np.maximum(count, 1)[owner]]))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over vote patterns: chances[class, labeller, vote + 1] and the share of good.

    Labellers are independent given the class.  The start says only that votes are more often
    right than wrong, and a labeller of one kind of poor text is held to at most FALSE_ALARM poor votes on
    good texts: without it, a kind that only one labeller knows would pass for noise.
    """
    n = patterns.shape[1]
    chances = np.zeros((2, n, 3))
    wary = (patterns < 0).any(axis=0) & ~(patterns > 0).any(axis=0)  # knows one kind of poor text only
    for j in range(n):
        if wary[j]:
            chances[:, j] = (0.2, 0.799, 0.001), (FALSE_ALARM, 0.999 - FALSE_ALARM, 0.001)
        elif (patterns[:, j] < 0).any():
            chances[:, j] = (0.4, 0.5, 0.1), (0.1, 0.5, 0.4)
        else:
            chances[:, j] = (0.01, 0.49, 0.50), (0.01, 0.19, 0.80)
    share = 0.8
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        post = posterior(patterns, chances, share)
        new = float((post * counts).sum() / counts.sum())
        for c, w in ((1, post * counts), (0, (1 - post) * counts)):
            chances[c] = (np.einsum("p,pjv->jv", w, hot) + 0.1) / (w.sum() + 0.3)
        over = np.where(wary, np.maximum(chances[1][:, 0] - FALSE_ALARM, 0), 0)
        chances[1][:, 0] -= over
        chances[1][:, 1] += over
        if abs(new - share) < 1e-9:
            break
        share = new
    return chances, min(max(share, 1e-6), 1 - 1e-6)


def posterior(patterns: np.ndarray, chances: np.ndarray, share: float) -> np.ndarray:
    """Chance of being good for each vote pattern."""
    at = np.arange(patterns.shape[1])
    good = np.log(chances[1][at, patterns + 1]).sum(axis=1) + np.log(share)
    poor = np.log(chances[0][at, patterns + 1]).sum(axis=1) + np.log(1 - share)
    return 1 / (1 + np.exp(np.clip(poor - good, -500, 500)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 40.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft labels ``y``, both classes weighing the same."""
    w, y = np.zeros(x.shape[1] + 1, x.dtype), y.astype(x.dtype)
    weigh = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    move = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        g = weigh * (p - y) / 2
        step = np.concatenate([x.T @ g, [g.sum()]])
        move = 0.9 * move + step + decay * w
        w = (w - rate * 0.1 * move).astype(x.dtype)
    return w.astype(float)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Scorer weights, labeller chances and share of good documents.

    Votes of all documents are counted by pattern (at most 3 to the power of the number of labellers); the scorer sees a
    bounded sample, drawn by a hash of id and text.
    """
    def count(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK):
                got, n = np.unique(votes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, p)) for p in got.tolist()]), pa.array(n.astype(np.int64))], ["pattern", "n"])

    seen = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not seen:
        return np.zeros(BINS + 1), np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in seen])
    counts = np.array([r["n"] for r in seen], float)
    chances, share = fit_labellers(patterns, counts)

    def describe(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK):
                own, cuts = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, bins, weight = features(own, cuts)
                cells, place = np.unique(row * BINS + bins, return_inverse=True)
                sums = np.bincount(place, weight, len(cells))
                ends = np.searchsorted(cells, np.arange(b - a + 1) * BINS)
                good = posterior(votes(own, cuts), chances, share)
                yield pa.RecordBatch.from_arrays([pa.array(good), pa.array([(cells[s:e] % BINS).astype(np.int32).tobytes() for s, e in zip(ends, ends[1:])], pa.binary()),
                                                  pa.array([sums[s:e].astype(np.float32).tobytes() for s, e in zip(ends, ends[1:])], pa.binary())], ["good", "bins", "sums"])

    draw = F.xxhash64(F.lit(6), "doc_id", "text")
    bar = int((min(1.0, 1.1 * sample / counts.sum()) - 0.5) * 2**64)
    drawn = docs.where(F.col("text").isNotNull() & (draw < F.lit(min(bar, 2**63 - 1)))).select("text", draw.alias("_d"))
    rows = drawn.orderBy("_d").limit(sample).select("text").mapInArrow(describe, "good double, bins binary, sums binary").collect()  # at most ``sample`` rows of BINS entries
    x, y = np.zeros((len(rows), BINS), np.float32), np.array([r["good"] for r in rows])
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["bins"], np.int32)] = np.frombuffer(r["sums"], np.float32)
    return (fit_scorer(x, y) if len(rows) else np.zeros(BINS + 1)), chances, share


def score_documents(docs: DataFrame, weights: np.ndarray, share: float = 0.5) -> DataFrame:
    """The columns of ``docs`` plus ``quality_score`` (0 to 1, six decimals; null and wordless texts: 0).

    The evidence of a text of few words is weak: its log-odds are drawn towards those of ``share``,
    the share of good documents, by as much as FEW words would weigh.
    """
    prior = float(np.log(share / (1 - share)))
    held = docs.sparkSession.sparkContext.broadcast(weights)  # BINS + 1 numbers
    at = docs.columns.index("text")
    schema = docs.drop("quality_score")
    keep = [i for i, c in enumerate(docs.columns) if c != "quality_score"]

    def work(batches):
        w = held.value
        for batch in batches:
            raw, offsets = texts_of(batch.column(at))
            for a, b in row_chunks(offsets, CHUNK):
                own, cuts = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, bins, weight = features(own, cuts)
                total = np.bincount(row, weight * w[bins], b - a) + w[-1]
                n = hash_words(own, cuts)[1]
                total = (total * n + prior * FEW) / (n + FEW)
                score = np.round(1 / (1 + np.exp(-np.clip(total, -500, 500))), 6)
                score[n == 0] = 0.0
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in keep], pa.array(score)], [*[batch.schema.names[i] for i in keep], "quality_score"])
    fields = schema.schema.add("quality_score", "double")
    return docs.mapInArrow(work, fields)


def judge(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` plus quality_score and ``accepted`` (score at least ``threshold``)."""
    weights, _, share = train(docs, sample)
    return score_documents(docs, weights, share).withColumn("accepted", F.col("quality_score") >= threshold)
