"""Mixing through shard quotas: brute-force twins on small blocks and runs."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridfold.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def test_shuffle_is_a_bijection(spark):
    salts = F.transform(F.sequence(F.lit(1), F.lit(mixing.ROUNDS)), lambda i: F.xxhash64(F.lit(7), i))
    for n in (1, 2, 3, 17, 256, 1000):
        got = [r.p for r in spark.range(n).select(mixing.shuffled(F.col("id"), salts, F.lit(n)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 17 or got != list(range(n))


@pytest.mark.parametrize("block,run,shards", [(16, 256, 16), (3, 2, 5), (1, 1, 3), (7, 4, 1)])
def test_shards_hold_their_quotas(spark, block, run, shards):
    """Words numbered within their document; every shard's words counted against its quota."""
    docs = spark.createDataFrame([(i, "abc"[min(i % 7, 2)] if i % 11 else None, " ".join(f"w{i}_{j}" for j in range(i * 13 % 60)) if i % 9 else None) for i in range(90)], "doc_id long, source string, text string")
    sizes = Counter()
    for d in docs.collect():
        sizes[d.source] += len((d.text or "").split())
    keys = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    quotas = mixing.block_quotas(mixing.source_targets(docs.groupBy(mixing._key().alias("key")).agg(F.sum(mixing.word_count("text")).alias("source_size")), (5, 2, 1)), block)
    blocks = {keys[r["rank"]]: r.blocks for r in quotas.collect()}
    due = Counter()
    for r in mixing.shard_quotas(quotas, shards).collect():
        s = keys[r["rank"]]
        due[s, r.shard] = max(0, min((r["from"] + r.blocks) * block, 3 * sizes[s]) - r["from"] * block)
    rows = mixing.mix_counts(docs, block=block, shards=shards, run=run).collect()
    source = {d.doc_id: d.source for d in docs.collect()}
    got = Counter()
    for r in rows:
        assert r.taken == sum(p.words for p in r.shard_words) <= 3 * r["size"]
        for p in r.shard_words:
            got[source[r.doc_id], p.shard] += p.words
    assert got == Counter({k: v for k, v in due.items() if v})
    mixed, pieces = Counter(), mixing.mix_documents(docs, block=block, shards=shards, run=run, shard_as="to").collect()
    per_shard = Counter()
    for p in pieces:
        mixed.update((p.text or "").split())
        per_shard[p.source, p.to] += len((p.text or "").split())
    assert {k: v for k, v in per_shard.items() if v} == dict(got)
    for s, n in blocks.items():  # no word is taken a second time before all of its source were
        times = [mixed[f"w{i}_{j}"] for i in source if source[i] == s and i % 9 for j in range(i * 13 % 60)]
        assert sum(times) == min(n * block, 3 * sizes[s]) and max(times) - min(times) <= 1


def test_runs_are_permuted_and_documents_stay_whole(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.expr("repeat('word ', 10)").alias("text"))
    rows = mixing.mix_counts(docs, weights=(1, 9), block=4, run=25).collect()
    part = [r.taken for r in rows if r.doc_id % 2 == 0]
    assert sum(1 for t in part if t == 10) > 180 and sum(1 for t in part if 0 < t < 10) <= 45  # few are cut, at the 21 runs' ends
    whole = mixing.mix_documents(docs, weights=(1, 9), block=4, run=25).where("source = 'b' and text = repeat('word ', 10)").groupBy("doc_id").count()
    assert whole.where("count >= 1").count() == 1000
