"""The output gate where a doubled id meets another fault of the same feature."""
import duckdb

from gridfold.plans import ORACLES, QUERIES


def test_doubled_ids_that_were_to_be_zero(spark, tmp_path):
    first = [k for k in range(150_000) if k % 41 == 1 and k // 41 % 50 == 3]
    keys = [x for k in first if k % 37 in (0, 1) for x in (k, k + 1)]
    assert keys
    rows = spark.createDataFrame([(k, k % 7, "F") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = {(r.site_id, r.error, r.n) for r in QUERIES["P15_output_gate"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(ORACLES["P15_output_gate"]).fetchall())
