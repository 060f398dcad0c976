"""Fill-in-middle, token counts and the Merkle manifest."""
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridfold.llm import fim, merkle, tokens
from gridfold.llm.common import texts_of
from gridfold.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = ["", "a", "ab cd", "éa日b😀c", "Abc" * 9, "x" * 8, "x" * 16 + "é", "\x00a\x00", "[`@{az", " " * 17, "naïve<P>x", "ÿÿ", "word " * 4000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle

def units_of(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def check_units(texts):
    raw, offsets = texts_of(pa.array(texts, pa.string()))
    got = fim.Units(raw, offsets)
    want = [units_of(t) for t in texts]
    assert got.n.tolist() == [len(u) for u in want]
    for part in (0.0, 0.3, 0.7, 1.0):
        k = np.array([int(len(u) * part) for u in want])
        cut = got.byte_after(k)
        assert cut.tolist() == [len("".join(u[:i]).encode()) for u, i in zip(want, k)]
        assert got.chars_before(cut).tolist() == [len("".join(u[:i])) for u, i in zip(want, k)]


def test_units_of_odd_texts():
    check_units(ODD)
    check_units([])
    check_units([""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZz@[`{é日😀 \x00\x7f\x80ÿ.") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_units_of_any_texts(texts):
    check_units(texts)


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    u = units_of(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 1000)
    more = spark.createDataFrame([(i, ODD[i % len(ODD)] + " <" * (i % 2)) for i in range(100, 260)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert sorted(map(repr, (((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out))) == sorted(repr((r.doc_id, *middle(r.doc_id, r.text))) for r in rows)
    assert sorted(r.back for r in out) == sorted(r.text or "" for r in rows)
    assert fim.fill_in_middle(no_docs).count() == 0


@pytest.mark.parametrize("name, table", [("op11_swar_fill_in_middle", "documents"), ("op13_path_copying_merkle", "documents")])
def test_query_matches_its_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(ORACLES[name])
    assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# token counts

@pytest.fixture(scope="module")
def library():
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def merges(library):
    return tokens.Merges.of_model(library[0])


def counted(merges, texts):
    return tokens.count_batch(merges, *texts_of(pa.array(texts, pa.string()))).tolist()


def test_counts_of_odd_texts(merges, library, dice):
    made = ["".join(dice.choice(a) for _ in range(dice.randrange(90))) for a in ("abcdefghij ", "the  in er ▁", " \t\nab", "日本語éтест x", "=-_/.#  ", "01 ab", " ", "<s></unk>x", "😀①ﬁ́é ", "aA")
            for _ in range(120)]
    long = ["a" * 5000, " " * 5000, "ab" * 3000, "".join(dice.choice("eitanorsh") for _ in range(4000)), "".join(dice.choice("eitan") for _ in range(2000)), "=" * 2047, "日" * 3000]
    texts = [*ODD, *made, *long]
    assert counted(merges, texts) == [len(x) for x in library[1].encode(texts)]
    assert counted(merges, []) == [] and counted(merges, ["", ""]) == [0, 0]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=50), max_size=5))
def test_counts_of_any_texts(merges, library, texts):
    assert counted(merges, texts) == [len(x) for x in library[1].encode(texts)]


def slow_bpe(text, pieces, scores):
    parts = list(text)
    while True:
        best = max(((scores[pieces.index(a + b)], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces), default=None)
        if best is None:
            return len(parts)
        i = -best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_both_ways_agree_with_one_merge_at_a_time(dice, monkeypatch):
    """Small vocabularies in any order of ranks, with ties: results may pair at once, and overlap."""
    for _ in range(60):
        pieces = ["▁", "a", "b", "c"]
        while len(pieces) < 14:
            new = dice.choice(pieces) + dice.choice(pieces)
            if new not in pieces and "▁" not in new.lstrip("▁"):
                pieces.append(new)
        scores = [float(dice.randrange(8)) for _ in pieces]
        small = tokens.Merges(pieces, scores)
        texts = ["".join(dice.choice("abc ") for _ in range(dice.randrange(1, 25))) for _ in range(40)]
        want = [slow_bpe("▁" + t.replace(" ", "▁"), pieces, scores) for t in texts]
        for limit in (1000, 1):
            monkeypatch.setattr(tokens, "LONG", limit)
            assert counted(small, texts) == want


def test_models_that_do_not_fit():
    with pytest.raises(ValueError):
        tokens.Merges(["a", "▁", "a▁"], [0.0, -1.0, -2.0])
    with pytest.raises(ValueError):
        tokens.Merges(["a", "ab"], [0.0, -1.0])


def test_token_counts(spark, odd_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 500)
    got = tokens.token_counts(odd_docs, library[0]).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library[1].encode(r.text or ""))) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, want))
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert tokens.token_counts(no_docs, library[0]).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_token_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op12_rank_synchronous_tokens"](spark, FOLDER).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), len(library[1].encode(r.text or ""))) for r in docs}


# Merkle manifest

def slow_tree(digests, fan):
    """Root and the siblings of every node, by rebuilding whole levels."""
    level, ways, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % fan
            ways[i].append(("".join(level[run:a]), "".join(level[a + 1:run + fan])))
        at = [a // fan for a in at]
        level = [sha("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
    return level[0], ways


def test_versions_share_all_but_their_copies(dice):
    for n in (1, 2, 8, 9, 64, 70):
        digests = [sha(str(i)) for i in range(n)]
        tree = merkle.Tree(digests, merkle.levels_above(n))
        assert tree.root == slow_tree(digests, 8)[0]
        for leaf in {0, n - 1, dice.randrange(n)}:
            version = tree.version(leaf, sha("new"))
            full = merkle.Tree([sha("new") if i == leaf else d for i, d in enumerate(digests)], merkle.levels_above(n))
            assert version.root == full.root
            for level, nodes in enumerate(full.levels):
                assert [version.node(level, i) for i in range(len(nodes))] == nodes
            assert len(version.copies) == len(tree.levels)  # one copy a level, the rest is the base tree's
        assert tree.levels[0] is digests


@pytest.mark.parametrize("fan, depth, sizes", [(8, 4, [1, 5, 30]), (2, 2, [1, 37, 4, 5]), (3, 1, [28, 2]), (2, 3, [1]), (2, 1, [1, 1, 1])])
def test_manifest_of_many_blocks(spark, fan, depth, sizes):
    """Small blocks: several distributed steps, keys that end at different ones, a null key, repeated ids."""
    rows = [(None if k == 1 else f"k{k}", i // 2 if i % 7 else None, sha(f"{k} {i}"), sha(f"new {i}") if i % 3 == 0 else None) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, id long, d string, c string")
    got = {r.leaf: r for r in merkle.manifest(df, "lang", "id", F.col("d"), F.col("c"), fan, depth).collect()}
    assert len(got) == len(rows)
    keys = sorted({r[0] for r in rows}, key=lambda k: (k is not None, k))
    own = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k in keys}
    trees = {k: slow_tree([r[2] for r in own[k]], fan) for k in keys}
    root, tops = slow_tree([trees[k][0] for k in keys], fan)
    for k, top in zip(keys, tops):
        for i, (_, item, leaf, changed) in enumerate(own[k]):
            r = got[leaf]
            way = trees[k][1][i] + top
            assert (r.key, r.item, r.idx, r.subroot, r.root) == (k, item, i, trees[k][0], root)
            assert [tuple(w) for w in r.way] == way
            copies = [changed or leaf]
            for left, right in way:
                copies.append(sha(left + copies[-1] + right))
            assert r.copies == copies and (r.copies[-1] == root) == (changed is None)


def test_document_manifest(spark, odd_docs, no_docs):
    got = merkle.document_manifest(odd_docs).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(r.leaf for r in got) == sorted(sha("".join(field(v) for v in r)) for r in rows)
    lower = {sha("".join(field(v) for v in r)): r for r in rows}
    assert len({r.root for r in got}) == 1
    for r in got:
        row = lower[r.leaf]
        hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0
        assert (r.copies[-1] == r.root) == (not hit or row.text is None or not re.search("[A-Z]", row.text))
    assert merkle.document_manifest(no_docs).count() == 0
