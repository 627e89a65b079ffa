"""Numbers of rows in one order over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts by approximate quantiles of the leading column; their counts are the only table broadcast.
PARTS = 256


def numbered(df: DataFrame, lead: str, then: list[Column], name: str) -> DataFrame:
    """df with a long column: each row's place, from 0, by `lead` (a long without nulls) upwards and then by `then`.

    df is read three times, so store what is costly first. A part holds about a PARTS-th of the rows, and
    more only where one value of `lead` does; rows equal in all of the order are numbered in any order.
    """
    cuts = df.agg(F.percentile_approx(lead, [i / PARTS for i in range(1, PARTS)], 20 * PARTS)).first()[0]
    bounds = sorted(set(cuts or []))
    # The number of bounds at or below the value; a chain of halvings, so eight comparisons a row.
    rows = df.withColumn("_part", _below(F.col(lead), bounds, 0, len(bounds)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(lead, *then)
    out = rows.withColumn("_nth", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_offset") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_offset")


def _below(x: Column, bounds: list[int], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < bounds[mid], _below(x, bounds, lo, mid)).otherwise(_below(x, bounds, mid + 1, hi))
