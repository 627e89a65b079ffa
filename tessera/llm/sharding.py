"""Rendezvous sharding: each key goes to the shard that scores highest for it.

A shard's score for a key depends on that key and shard alone, so one more shard takes rows only
into itself, and a shard that leaves gives up only its own rows. With weights w the score is
-w / ln(u), u uniform in (0, 1) from the hash of key and shard, which gives each shard its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which each shard's rows are split to number them; their counts are the only table broadcast.
SLOT_BUCKETS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(F.concat_ws("\u0000", key, F.lit(str(shard)))), 11)
    return -F.lit(float(weight)) / F.log((h.cast("double") + 0.5) / float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, an int from 0. A null key is the key of the empty text with a mark of its own."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a weight above zero")
    key = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scored = [F.struct(_score(key, k, w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best.getField("k")).cast("int")


def shard_rows(df: DataFrame, key_col: str, text_col: str, weights: Sequence[float]) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for each row.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of its bytes (null: of none), shard
    follows the key and the weights alone, slot numbers a shard's rows from 0 without gaps, and
    grown_shard is the shard with one more of weight 1. Repeated rows all stay and get slots of their
    own; null keys share one shard. Only the two named columns are read, so others cannot clash. An
    empty table gives an empty result.

    Texts are reduced to a size and a checksum before anything moves. Slots come from counts of
    SLOT_BUCKETS buckets a shard and a numbering within each bucket, so no task holds a whole shard.
    """
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(key_col).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous(F.col("key"), weights), "grown_shard": rendezvous(F.col("key"), [*weights, 1.0])})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # At most weights x SLOT_BUCKETS rows, whatever the input.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "key", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )
