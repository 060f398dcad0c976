"""Rows made to break an operator: colliding words, one id with two texts, common vectors, last code points, other partitions."""
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridfold.llm import balltree, quality, sketches, urls

COPY = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees"


def test_words_that_collide_under_a_polynomial(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    rows = [(1, bits), (2, other), (3, bits.upper()), (4, f"{bits} x"), (5, f"{other} x")]
    got = {r.doc_id: r.component_id for r in sketches.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert sketches.shingle_words("A b\tc\x85d", 2) == {(b"a", b"b"), (b"b", "c\x85d".encode())} and sketches.shingle_words(" a ", 2) == {(b"a",)} and not sketches.shingle_words(" ", 2)


def test_one_id_with_several_texts(spark):
    far = "entirely different words stand in this other text and none of them was ever seen before in any sentence above or below it"
    rows = [(1, COPY, "a"), (1, far, "b"), (1, far, "c"), (2, COPY + " now", "d"), (3, far + " today", "e"), (4, "short", "f"), (None, COPY, "g"), (5, None, "h"), (5, None, "i"), (6, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_copy_stage(spark, docs, "").collect()
    # an id that occurs once goes before one that repeats; both texts of id 1 have a near copy, the null texts are one row
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("2", COPY + " now"), ("3", far + " today"), ("4", "short"), ("None", COPY)])
    assert sorted(str(r.doc_id) for r in kept if not r.text) == ["5", "6"]
    alone = corpus_pipeline.near_copy_stage(spark, docs.where("doc_id = 1"), "").collect()
    assert sorted(r.text for r in alone) == sorted([COPY, far])


@pytest.mark.parametrize("shard", [8192, 40])
def test_common_vectors_with_repeated_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(balltree, "SHARD", shard)
    dice = random.Random(1)
    rows = [(i, [3, -2, 5]) for i in range(30) for _ in range(12)] + [(100 + i, [dice.randrange(-4, 5) for _ in range(3)]) for i in range(80)]
    rows += [(200, [9, 9, 9])] * 15
    dice.shuffle(rows)
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = [(0, [3, -2, 5]), (20, [3, -2, 5]), (200, [9, 9, 9]), (777, [1, 1, 1])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in balltree.top_k(vectors, spark.createDataFrame(asked, "vec_id long, v array<long>")).collect())
    want = []
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_last_code_points_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(urls, "PER_PART", 20)
    pages = [(i, f"http://a.com/en/{urls.LAST * (1 + i % 3)}{i}") for i in range(300)] + [(1000 + i, f"http://a.com/{urls.LAST * 2}{i}") for i in range(60)] + [(2000 + i, f"http://a.com/eo{i}") for i in range(40)]
    rules = [("a.com", "/en/", "block"), ("a.com", "/" + urls.LAST, "block"), ("com", "", "allow")]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert all(r.verdict == ("allow" if r.page_id >= 2000 else "block") for r in out) and len(out) == 400
    assert urls.past(("com",), "/a") == (("com",), "/b") and urls.past(("com",), urls.LAST) == (("com", ""), "")


def test_very_long_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "PER_PART", 20)
    pages = [(i, "http://a.com/" + "x" * 3000 + str(i)) for i in range(100)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([("com", "/" + "x" * 2000, "block")], "host string, path string, verdict string")).collect()
    assert all(r.verdict == "block" for r in out)


def test_scorer_does_not_depend_on_partitions(spark):
    dice = random.Random(3)
    words = ["".join(dice.choice(string.ascii_lowercase) for _ in range(dice.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(dice.choice(words) for _ in range(40)) + "." if i % 4 else "BUY | NOW | " * 12) for i in range(900)]
    scores = []
    for parts in (3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.col("doc_id") % parts)
        scores.append({r.doc_id: (r.quality_score, r.accepted) for r in quality.judge(docs, sample=200).collect()})
    assert scores[0] == scores[1]


def test_chance_bands_chain_nothing(spark):
    """Documents that share one band by chance are no candidates; similar ones are, beside an unrelated hub and in wide bands too."""
    rng = np.random.default_rng(6)
    draw = lambda: rng.integers(0, 60000, sketches.REGISTERS).astype(np.uint16)
    chain = [draw() for _ in range(50)]
    for i, (a, b) in enumerate(zip(chain, chain[1:])):  # 0 and 1 share a band, 1 and 2 another one, and so on
        at = i % sketches.BANDS * sketches.ROWS
        b[at:at + sketches.ROWS] = a[at:at + sketches.ROWS]
    base = draw()
    group = [np.where(rng.random(sketches.REGISTERS) < .9, base, draw()) for _ in range(2 * sketches.FEW)]
    for x in group[5:]:
        x[:sketches.ROWS] = base[:sketches.ROWS]
    hub = draw()
    hub[:sketches.ROWS] = base[:sketches.ROWS]
    rows = [(i, x.tobytes()) for i, x in enumerate([*chain, hub, *group])]
    edges = sketches.candidate_edges(spark.createDataFrame(rows, "rep long, registers binary"), 80)
    roots = {r.node: r.root for r in sketches.components(edges).collect()}
    assert roots == {i: 51 for i in range(51, 51 + len(group))}
    assert sketches.candidate_edges(spark.createDataFrame(rows[:1], "rep long, registers binary"), 80).count() == 0
