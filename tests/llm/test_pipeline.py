"""The stages one after the other, each held against what its operator promises."""
import re
from collections import Counter

import corpus_pipeline
from gridfold.llm.common import WORD
from gridfold.session import scratch
from tests.llm.test_text import near

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        states[name] = docs.collect()
        if name != "packing":
            assert docs.columns == first.columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r.doc_id: r.text for r in states["quality"]}
    assert all((i in good) == (q == 1) for i, q in label.items())
    groups = near(good, 5, 80)
    assert {r.doc_id for r in states["near copies"]} == {i for i, (_, c) in groups.items() if i == c}
    before = {r.doc_id: r.text for r in states["near copies"]}
    assert {r.doc_id: r.text for r in states["secrets"]} == {i: re.sub(r'(?<=token = ")[0-9a-f]{40}', "<secret>", t) for i, t in before.items()}
    mixed, packed = Counter(), Counter()
    for r in states["mixing"]:
        mixed[r.doc_id] += len(re.findall(WORD, r.text))
    for r in states["packing"]:
        packed[r.doc_id] += r.tokens
    assert +mixed == +packed and set(mixed) <= set(before)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            path = scratch(spark, "stage")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "packing" or docs.columns == start.columns
    kept = corpus_pipeline.near_copy_stage(spark, odd_docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "4", "5", "6", "7", "9", "None"])
