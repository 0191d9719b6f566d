"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """v and root for each end of ``links`` (a, b): every vertex of a component has the same root.

    In a round each vertex points to its smallest neighbour (twice, by a jump) and the links are redrawn between what is
    pointed at; a round leaves half of the vertices at most, so there are few. Rounds are written tables.
    """
    roots, now = None, links.select("a", "b").where("a != b").distinct()
    while True:
        both = now.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("w")))
        to = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        to = saved(to.alias("x").join(to.select(F.col("v").alias("p"), F.col("p").alias("root")), "p").select("v", "root"), "parents")
        if roots is None:
            roots = to
        else:
            roots = saved(roots.join(to.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root")), "roots")
        a, b = to.select(F.col("v").alias("a"), F.col("root").alias("x")), to.select(F.col("v").alias("b"), F.col("root").alias("y"))
        now = saved(now.join(a, "a").join(b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if now.isEmpty():
            return roots
