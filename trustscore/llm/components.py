"""Connected components of an edge table by hooking and pointer jumping, as joins and minima.

Each round is written to the shared folder, so lineage stays short and lost executors cost one round.
Minima combine map-side and joins are plain equi-joins, so a hub of any degree is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustscore.session import materialized


def _total(parents: DataFrame) -> tuple:
    """Parents only ever fall, so an unchanged sum means an unchanged table."""
    return tuple(parents.agg(F.count("*"), F.sum(F.col("f").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``): the smallest node it is linked to, itself included."""
    both = materialized(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    parents = materialized(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("f")), "parents")
    total = _total(parents)
    while True:
        grand = parents.join(parents.select(F.col("a").alias("f"), F.col("f").alias("g")), "f").select("a", "f", "g")
        near = (
            both.join(grand.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        )
        offers = grand.join(near, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.least("g", "m").alias("f")),
                    F.struct(F.col("f").alias("a"), F.least("g", "m").alias("f")),
                )
            ).alias("o")
        )
        parents = materialized(offers.groupBy(F.col("o.a").alias("a")).agg(F.min("o.f").alias("f")), "parents")
        after = _total(parents)
        if after == total:
            return parents.select(F.col("a").alias("node"), F.col("f").alias("root"))
        total = after
