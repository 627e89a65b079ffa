"""Connected components of a link table by alternating large and small stars.

Each round is one aggregation and one equi-join over the links; the link table never leaves the
cluster, and each round's table is checkpointed, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node that has a link, with the smallest node of its component.

    Self-links and nulls are no links; without links the result is empty.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    before = None
    while True:
        now = _star(_star(now, True), False).checkpoint()
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
