"""Every registered query against its SQL twin on the smallest tables."""
import os

import duckdb
import pytest

from gridfold.plans import ORACLES, QUERIES
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_manifests_of_all_documents(spark, con, tmp_path, monkeypatch):
    from gridfold.plans import exports
    monkeypatch.setattr(exports, "scratch", lambda *_: str(tmp_path / "manifests"))
    got = exports.manifests_of(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    want = con.sql("SELECT CAST(doc_id % 97 AS VARCHAR), count(*), count(*) > 1 FROM documents GROUP BY ALL").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(list((tmp_path / "manifests").glob("site=*"))) == len(want) <= 97 and len(list((tmp_path / "manifests").rglob("*.txt"))) <= 8 * 97


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, text, ok = compare(spark, FOLDER, name, QUERIES[name], ORACLES.get(name), con)
    assert ok, text
