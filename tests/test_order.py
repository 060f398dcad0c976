"""Steps that must not depend on the order in which shuffled rows arrive."""
import random

import numpy as np
from pyspark.sql import functions as F

from gridfold.operators import order


def test_percentiles_with_cuts_that_vary(spark, monkeypatch):
    """A merged sketch proposes other cuts when its parts arrive in another order; one evaluation has to serve all steps."""
    @F.udf("array<double>")
    def some(values):
        return [random.SystemRandom().choice(values) for _ in range(20)]
    monkeypatch.setattr(order.F, "approx_percentile", lambda v, grid, accuracy: some(F.collect_list(v)))
    rng = np.random.default_rng(3)
    groups = {k: rng.normal(size=500 + 3 * k) for k in range(6)}
    d = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "site_id int, v double")
    got = {r.site_id: r.q for r in order.exact_percentiles(d, ["site_id"], "v", [0.3, 0.75]).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(x, [0.3, 0.75]), rtol=0, atol=1e-12)
