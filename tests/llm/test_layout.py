"""Packing, sharding and mixing."""
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.llm import mixing, packing, sharding
from gridfold.llm.common import WORD, numbered, running_total, word_pieces

FOLDER = "/root/testdata/sf0.001"


def words(t):
    import re
    return re.findall(WORD, t or "")


def test_running_total_and_numbers(spark, dice):
    rows = [("k" if dice.random() < 0.5 else dice.choice("ab"), dice.randrange(-2**63, 2**63), dice.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "key string, h long, v long")
    got = running_total(df, "key", "h", "v", "before").collect()
    for r in got:
        assert r.before == sum(v for k, h, v in rows if k == r.key and h < r.h)
    seen = sorted((r.n, r.h) for r in numbered(df, ["h"], "n").collect())
    assert [n for n, _ in seen] == list(range(400)) and [h for _, h in seen] == sorted(h for _, h, _ in rows)
    sums = numbered(df, ["h"], "n", "v").collect()
    assert all(r.n == sum(v for _, h, v in rows if h < r.h) for r in sums)
    same = spark.createDataFrame([(1,)] * 50, "x long")
    assert sorted(r.n for r in numbered(same, ["x"], "n").collect()) == list(range(50))


def test_word_pieces_join_back(spark, odd_docs):
    for r in odd_docs.where("text is not null").select("text", word_pieces(F.col("text")).alias("p")).collect():
        assert "".join(r.p) == r.text
        assert all(len(words(x)) == 1 for x in r.p[:len(words(r.text))])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 100, 1000])
def test_permutation(n):
    for seed in (0, 9):
        p = sharding.permute(np.arange(n), n, seed)
        assert sorted(p.tolist()) == list(range(n))
        assert (sharding.permute(p, n, seed, back=True) == np.arange(n)).all()
    if n == 1000:
        assert (sharding.permute(np.arange(n), n, 0) != sharding.permute(np.arange(n), n, 9)).any()


def test_shards(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = sharding.shard_documents(docs, 40).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(text)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 40
    order = sorted(text)  # row numbers follow doc_id
    for r in out[:20]:
        assert order[sharding.row_at(r.shard, r.slot, len(text), 40)] == r.doc_id
    again = sharding.shard_documents(docs.repartition(5), 40).collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in again}
    odd = sharding.shard_documents(odd_docs, 4).collect()
    assert len(odd) == odd_docs.count() and [r["size"] for r in odd if r.doc_id == 3] == [16]
    assert sharding.shard_documents(no_docs, 4).count() == 0


def padding(lengths, counts, ends):
    total = 0
    for n, c in zip(lengths, counts):
        total += c * (min(e for e in ends if e >= n) - n)
    return total


def test_boundaries_are_optimal(dice):
    for _ in range(60):
        lengths = sorted(dice.sample(range(60), dice.randrange(1, 9)))
        counts = [dice.randrange(1, 50) for _ in lengths]
        k = dice.randrange(1, 5)
        ends = packing.best_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert len(ends) <= k and padding(lengths, counts, ends) == best
    assert packing.best_boundaries([], [], 4) == []


def test_pack(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = packing.pack(docs, buckets=5, longest=500, budget=2000, with_text=True).collect()
    byrow, batches = {}, {}
    for r in out:
        assert r.tokens <= r.width and len(words(r.text)) == r.tokens
        byrow.setdefault(r.doc_id, []).append(r)
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert {i: "".join(x.text for x in sorted(rs, key=lambda x: x.piece)) for i, rs in byrow.items()} == text
    room = {r.bucket: max(1, 2000 // r.width) for r in out}
    last = {b: max(n for c, n in batches if c == b) for b in room}
    for (b, n), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room[b] or n == last[b] and len(slots) <= room[b])
    odd = packing.pack(odd_docs, longest=4096, with_text=True).collect()
    assert len(odd) == odd_docs.count() - 1 + 8 and sum(r.tokens for r in odd if r.doc_id == 6) == 30_000
    assert [r.tokens for r in odd if r.doc_id == 3] == [0] and packing.pack(no_docs).count() == 0


def shared_out(sizes, weights, ceiling=3):
    total, full = sum(sizes), set()
    while True:
        level = (total - sum(ceiling * sizes[i] for i in full)) / sum(w for i, w in enumerate(weights) if i not in full) if len(full) < len(sizes) else 0
        more = {i for i, s in enumerate(sizes) if weights[i] * level >= ceiling * s}
        if more <= full:
            return [ceiling * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= more


def highest_quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_targets_and_quotas(spark, dice):
    for _ in range(3):
        sizes = [dice.choice([0, 5, 40, 300, 2000]) + dice.randrange(7) for _ in range(dice.randrange(2, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "key string, source_size long")
        targets = mixing.source_targets(df, (5, 2, 1))
        got = [r.target for r in targets.orderBy("rank").collect()]
        want = shared_out(sizes, weights)
        assert got == pytest.approx(want)
        quotas = mixing.block_quotas(targets, 16)
        assert [r.blocks for r in quotas.orderBy("rank").collect()] == highest_quotients(got, round(sum(got) / 16))
        per = mixing.shard_quotas(quotas, 3).collect()
        whole = {r["rank"]: r.blocks for r in quotas.collect()}
        for k, n in whole.items():
            own = sorted((r.shard, r.blocks, r["from"]) for r in per if r["rank"] == k)
            assert sum(b for _, b, _ in own) == n and max(b for _, b, _ in own) - min(b for _, b, _ in own) <= 1
            assert [f for _, _, f in own] == [0, own[0][1], own[0][1] + own[1][1]]
        totals = [sum(r.blocks for r in per if r.shard == s) for s in range(3)]
        assert max(totals) - min(totals) <= 1


def test_mix(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mix_counts(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 17 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_counts(docs.repartition(3)).collect()))
    mixed = {}
    for r in mixing.mix_documents(docs).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
    assert mixed == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix_counts(odd_docs).count() == odd_docs.count()
    odd = mixing.mix_documents(odd_docs)
    assert odd.columns == odd_docs.columns and {r.doc_id for r in odd.collect()} >= {3, 4, 5}
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
