"""Language-model and embedding interfaces, and doubles that need neither network nor model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def chat(self, system: str, user: str) -> str: ...


class Reranker(Protocol):
    def order(self, query: str, texts: Sequence[str]) -> list[int]: ...


class HashEmbedder:
    """Signed feature hashing (FNV-1a) of tokens, at length 1; equal texts have equal vectors."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = 14695981039346656037
                for b in w.encode():
                    h = ((h ^ b) * 1099511628211) & (2**64 - 1)
                v[h % self.dim] += -1.0 if h >> 63 else 1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class ScriptedChat:
    """Answers by the first rule whose pattern the prompt matches; otherwise the default."""

    def __init__(self, rules: Sequence[tuple[str, str]] = (), default: str = "") -> None:
        self.rules, self.default = list(rules), default

    def chat(self, system: str, user: str) -> str:
        return next((a for p, a in self.rules if re.search(p, system + "\n" + user, re.S)), self.default)


class KeepOrder:
    """The reranker that changes nothing."""

    def order(self, query: str, texts: Sequence[str]) -> list[int]:
        return list(range(len(texts)))


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding") -> DataFrame:
    """rows with an embedding of their text; Arrow batches, one call to the embedder a batch."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(to).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{to: embedder.embed(f[text].fillna("").tolist())})

    return rows.drop(to).mapInPandas(run, ", ".join([*fields, f"`{to}` array<float>"]))


def asked(rows: DataFrame, chat: Chat, system: str, prompt: str = "prompt", to: str = "reply", parallel: int | None = None) -> DataFrame:
    """rows with the model's reply to their prompt; a failed call is a null reply. parallel bounds the calls at a time."""
    x = rows.repartition(parallel) if parallel else rows
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> str | None:
            try:
                return chat.chat(system, p)
            except Exception:
                return None

        for f in frames:
            yield f.assign(**{to: [one(p) for p in f[prompt]]})

    return x.mapInPandas(run, ", ".join([*fields, f"`{to}` string"]))


def reranked(rows: DataFrame, query: str, reranker: Reranker, most: int = 40) -> DataFrame:
    """rows (id, text, score) with position: the reranker's order of the first `most`, the rest as they were.

    An answer that is no permutation changes nothing. At most `most` rows reach the driver.
    """
    head = rows.orderBy(F.desc("score"), F.asc("id")).limit(most).select("id", "text").collect()
    try:
        order = reranker.order(query, [r.text for r in head])
    except Exception:
        order = []
    if sorted(order) != list(range(len(head))):
        order = list(range(len(head)))
    if not head:
        return rows.withColumn("position", F.lit(None).cast("int"))
    place = rows.sparkSession.createDataFrame([(head[i].id, k) for k, i in enumerate(order)], rows.select("id").schema.add("position", "int"))
    return rows.join(F.broadcast(place), "id", "left")
