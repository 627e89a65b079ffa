"""Search history: records, lists, feedback as labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST_LIMIT = 20


def newest(entries: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest entries (id, created_at), later ids first at one time; a limit of 0 or less is LIST_LIMIT."""
    return entries.orderBy(F.desc("created_at"), F.desc("id")).limit(limit if limit > 0 else LIST_LIMIT)


def recorded(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """entries with new ones, whose ids follow the last in the order of created_at."""
    # One batch of records at a time: their order among themselves needs one task.
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    nth = F.row_number().over(Window.orderBy("created_at", "query"))
    new = incoming.withColumn("nth", nth).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("nth"))
    return entries.unionByName(new.select([c for c in entries.columns if c in new.columns]), allowMissingColumns=True)


def rated(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """entries with the feedback and feedback_at of ratings (id, feedback, at); the last rating of an entry holds."""
    r = ratings.groupBy("id").agg(F.max_by(F.struct("feedback", "at"), F.struct("at", "feedback")).alias("r"))
    x = entries.join(r, "id", "left")
    hit = F.col("r").isNotNull()
    return x.withColumns({"feedback": F.when(hit, F.col("r.feedback")).otherwise(F.col("feedback")), "feedback_at": F.when(hit, F.col("r.at")).otherwise(F.col("feedback_at"))}).select(entries.columns)


def labelled(entries: DataFrame) -> DataFrame:
    """(id, query, document_ids, label, provenance, labelled_at) of each rated entry, the time of the rating or else of the search."""
    x = entries.where("feedback <> 0")
    return x.select("id", "query", "document_ids", F.when(F.col("feedback") < 0, "not_relevant").otherwise("relevant").alias("label"), F.lit("user-feedback").alias("provenance"), F.coalesce("feedback_at", "created_at").alias("labelled_at"))
