"""Sinks: documents as files or tables, several at once, and what a table holds as a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_id
from . import parse

Sink = Callable[[DataFrame], None]


def rendered(documents: DataFrame) -> DataFrame:
    """(source, name, text) of documents: each as a text with its fields in front."""
    cols = ["id", "source", "kind", "title", "url", "updated_at", "visibility", "summary"]
    x = documents.withColumns({c: F.col(c).cast("string") for c in cols}).withColumn("name", F.concat(sanitize_id(F.col("id")), F.lit(".md")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [parse.render({**{k: v for k, v in (r.get("frontmatter") or {}).items()}, **{c: r[c] for c in cols}}, r["body"] or "") for r in f.to_dict("records")]
            yield pd.DataFrame({"source": f["source"], "name": f["name"], "text": text})

    return x.mapInPandas(run, "source string, name string, text string")


def file_sink(root: str) -> Sink:
    """Writes rendered documents under root by source; Spark's committer makes each write appear as a whole."""
    return lambda documents: rendered(documents).write.mode("append").partitionBy("source").parquet(root)


def tee(*sinks: Sink) -> Sink:
    """One batch to several sinks, computed once."""

    def run(documents: DataFrame) -> None:
        kept = documents.persist()
        try:
            for s in sinks:
                s(kept)
        finally:
            kept.unpersist()

    return run


def api_sink(post: Callable[[list[dict]], None], batch: int = 200) -> Sink:
    """Hands documents to a function in batches, from the tasks; a failed call fails its task, which Spark tries again."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f.to_dict("records")
            for a in range(0, len(rows), batch):
                post(rows[a : a + batch])
            yield pd.DataFrame({"n": [len(rows)]})

    return lambda documents: documents.mapInPandas(send, "n long").write.format("noop").mode("overwrite").save()


def remaining(stored: DataFrame, seen: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """stored without what a full fetch did not see; with prefixes only ids with one may go."""
    gone = stored.join(seen.select("id"), "id", "left_anti")
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("id").startswith(p)
        gone = gone.where(hit)
    return stored.join(gone.select("id"), "id", "left_anti")


def without(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def backup(tables: dict[str, DataFrame], to: str) -> None:
    """Each table as Parquet under a fresh folder."""
    for name, t in sorted(tables.items()):
        t.write.mode("errorifexists").parquet(f"{to}/{name}.parquet")
