"""Failure diagnosis helpers: strips between neighbouring labels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernels as N
from gridfold.operators import pairs as P
from gridfold.operators import spans as S
from gridfold.session import pin


def adjacent_strips(labels: DataFrame, keys: list[str], distance: float, res: float) -> DataFrame:
    """Cells between each pair of labels at most ``distance`` apart (one row per strip cell,
    a NULL cell when the strip is empty): ``keys, a, b, kind, gap_cells_sq, row, col``.

    More than 5 cm apart: cells touched within gap + 5 cm of both and inside neither.
    Otherwise: cells touched within 30 cm of both.
    """
    boxed = P.with_box(labels.select(*keys, "id", "spans"))
    two = P.box_join(boxed, boxed, keys, reach=int(distance / res + 1e-6), extra=F.col("id") < F.col("o_id"))
    two = pin(two, g=S.gap_sq(F.col("spans"), F.col("o_spans"))).where(F.col("g") <= (distance / res) ** 2 + 1e-6)
    apart = F.sqrt("g") * res > 0.05 + 1e-9
    reach = F.when(apart, F.sqrt("g") + 0.05 / res).otherwise(0.3 / res)
    two = two.withColumn("reach", reach).withColumn("apart", apart)
    out = pin(two, cells=N.strip_cells(F.col("spans"), F.col("o_spans"), F.col("reach"), F.col("apart")))
    return out.select(*keys, F.col("id").alias("a"), F.col("o_id").alias("b"), F.when(F.col("apart"), "gap").otherwise("touching").alias("kind"),
                      F.col("g").alias("gap_cells_sq"), F.explode_outer("cells").alias("c")).select(*keys, "a", "b", "kind", "gap_cells_sq", "c.row", "c.col")
