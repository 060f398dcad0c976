"""URL rules, exact search and media."""
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridfold.llm import balltree, media, urls
from gridfold.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def fits(rule, host, path):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


@pytest.mark.parametrize("part", [urls.PER_PART, 40])
def test_url_rules(spark, dice, monkeypatch, part):
    monkeypatch.setattr(urls, "PER_PART", part)  # small ranges: rules and hot keys reach over several
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "x.net", "WWW.A.com", "aa.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/a/b", "/fr/", "/é/"]
    rules = [(h.lower(), p, dice.choice(["allow", "block"])) for h in hosts[:7] for p in paths[1:] if dice.random() < 0.4]
    pages = [(i, "http://a.com/en/" if dice.random() < 0.4 else "https://" + dice.choice(hosts) + dice.choice(paths) + dice.choice(["", "?q=/x", "#f", "//y?z"])) for i in range(400)]
    pages += [(900, None), (901, "no scheme"), (902, "a://"), (None, "http://a.com/en/a")]
    df = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in pages], "page_id long, url string, host string, path string, rule string")
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)
    for r in got:
        best = max(((len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if fits((h, p), r.host, r.path)), default=None)
        assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "allow"))
    assert {(r.host, r.path) for r in got if r.page_id in (900, 901, 902)} == {("", "")}
    assert urls.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in urls.judge(df, spark.createDataFrame([], "host string, path string, verdict string"), "block").collect()} == {"block"}


def test_url_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    a = QUERIES["op8_url_rules"](spark, FOLDER).toPandas().sort_values("page_id").reset_index(drop=True)
    b = con.sql(ORACLES["op8_url_rules"]).df().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a.fillna("-"), b[a.columns].fillna("-"), check_dtype=False)


def brute_top(rows, queries, k=10):
    out = []
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [balltree.SHARD, 30])
def test_top_k(spark, dice, monkeypatch, shard):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "BLOCK", 7)
    monkeypatch.setattr(balltree, "LEAF", 4)
    rows = [(i, [dice.choice([-1.0, 0.0, 0.25, 0.5, dice.random()]) for _ in range(3)]) for i in range(200)] + [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)]
    bad = [(300, None), (None, [1.0, 1.0, 1.0]), (400, [1.0, None, 1.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    vectors = balltree.quantised(df)
    got = balltree.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == brute_top(fine, [r for r in fine if r[0] % 20 == 0])


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    v = balltree.quantised(df)
    assert sorted(map(tuple, balltree.top_k(v, v.where("vec_id = 0")).collect())) == [(0, 1, 1, 3 * 1024 * 1024), (0, 2, 2, -3 * 1024 * 1024)]
    assert balltree.top_k(v.limit(0), v.limit(0)).count() == 0 and balltree.top_k(v, v.where("vec_id = 99")).count() == 0


def test_tree_bounds(dice):
    v = np.array([[dice.randrange(-50, 50) for _ in range(5)] for _ in range(500)], float)
    order, nodes, centres, radii = balltree.build_tree(v)
    assert sorted(order.tolist()) == list(range(500))
    for (a, b, _, _), c, r in zip(nodes, centres, radii):
        assert np.sqrt(((v[order[a:b]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_video_round_trip(dice):
    loads = [bytes(dice.randrange(256) for _ in range(64 * dice.randrange(1, 40))) for _ in range(12)] + [b"\xff" * 64, b"\x00" * 128, b"\xff\x00" * 640]
    for load, file, got in zip(loads, (files := media.write_videos(loads)), media.read_videos(files)):
        assert got[0].tobytes() == load and got[1] == media.FRAME_US and len(got[2]) == -(-len(load) // 512)
        frames, step, size = media.parse_index(file)
        assert size == len(load) and all(file[a:a + 2] == b"\xff\xd8" and file[b - 2:b] == b"\xff\xd9" for a, b in frames)
    assert media.read_videos([b"", b"RIFF", files[0][:-9], files[1], b"\x00" * 99])[:3] == [None] * 3
    assert media.read_videos([b"junk", files[1]])[1][0].tobytes() == loads[1]


def test_shots():
    still, other = np.eye(16, dtype=np.int64)[[0] * 6] * 512, np.eye(16, dtype=np.int64)[[9] * 5] * 512
    assert media.shots(np.concatenate([still, other, still])) == [0, 6, 11]
    assert media.shots(still) == [0] and media.shots(still[:1]) == [0]


def test_media_digest(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    text = {r.doc_id: r.text for r in docs.where("doc_id > 9").collect()}
    rows = media.media_digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in text:
            load = text[r.doc_id].encode()
            full = load.ljust(max(64, -(-len(load) // 64) * 64), b"\x00")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(load), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    empty = media.media_digest(odd_docs.where("doc_id in (3, 4)")).collect()
    assert [(r.n_bytes, r.payload_bytes) for r in empty] == [(0, 64)] * 2 and empty[0][4:] == empty[1][4:]
    videos = media.encode_documents(odd_docs)
    clips = media.clip_rows(videos.where("doc_id = 6")).orderBy("clip").collect()
    assert clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(clips, clips[1:]))
    broken = spark.createDataFrame([(1, 3, b"no video"), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.payload_sha256 is None for r in media.read_media(broken).collect())
    assert media.media_digest(no_docs).count() == 0
