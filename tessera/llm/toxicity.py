"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a logistic model over hashed words and word
beginnings, scaled by their log-count ratio, and each model after the first also sees the probabilities
of the categories before it, so the category that decides stands last. In training those are
out-of-fold: a row's earlier probabilities come from models that have not seen the row, so later models
meet them as they will be met in prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

#: Labelled rows that the fit takes at most: those of smallest hash of id and text.
FIT_ROWS = 5_000
#: Texts of the fit that a feature must be in to get a weight.
LEAST_TEXTS = 5
#: Chi-square of feature and category that a feature needs: few of FEATURES reach it by chance.
LEAST_CHI2 = 20.0
#: Lengths of the word beginnings that are features beside the word.
STARTS = (4, 5, 6)
FEATURES = 1 << 18
FOLDS = 4

_WORD = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
_TABLE_WORDS = 150_000
#: Texts that are predicted at once; bounds a task's memory.
STEP_ROWS = 256


class Hasher:
    """Feature numbers of words, remembered up to a bound."""

    def __init__(self, features: int = FEATURES) -> None:
        self.features = features
        self.seen: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        import xxhash

        parts = [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]
        return tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 7) % self.features for p in parts)

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct features of a text, in order."""
        seen, out = self.seen, set()
        for w in set(_WORD.findall((text or "").lower())):
            if (k := seen.get(w)) is None:
                if len(seen) >= _TABLE_WORDS:
                    seen.clear()
                k = seen[w] = self._of_word(w)
            out.update(k)
        return np.sort(np.fromiter(out, np.int64, len(out)))


class Rows:
    """Sets of features, a set a row, and columns of earlier probabilities."""

    def __init__(self, rows: Sequence[np.ndarray], extra: np.ndarray) -> None:
        self.at = np.concatenate([np.zeros(0, np.int64), *rows])
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.extra = extra

    def take(self, which: np.ndarray, features: np.ndarray | None = None) -> Rows:
        """Some rows; with a mask of features, only those."""
        out = object.__new__(Rows)
        place = np.full(len(self.extra), -1)
        place[which] = np.arange(len(which))
        keep = place[self.row] >= 0
        if features is not None:
            keep &= features[self.at]
        out.at, out.row, out.extra = self.at[keep], place[self.row[keep]], self.extra[which]
        return out


class Linear:
    """A logistic model: feature weights, weights of earlier categories, bias."""

    def __init__(self, features: int, extras: int) -> None:
        self.w, self.v, self.b = np.zeros(features), np.zeros(extras), 0.0

    def probabilities(self, x: Rows) -> np.ndarray:
        margin = np.bincount(x.row, self.w[x.at], len(x.extra)) + x.extra @ self.v + self.b
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, x: Rows, y: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-6) -> Linear:
        """Full-batch descent with a step size for each weight, over features that are frequent and tell the classes apart."""
        yes, no = y.sum(), len(y) - y.sum()
        a = np.bincount(x.at, y[x.row], len(self.w))
        b = np.bincount(x.at, minlength=len(self.w)) - a
        ratio = np.log((a + 0.5) / (yes + 1)) - np.log((b + 0.5) / (no + 1))
        share = np.clip(yes / max(len(y), 1), 1e-9, 1 - 1e-9)
        telling = (a - (a + b) * share) ** 2 >= LEAST_CHI2 * np.maximum(a + b, 1) * share * (1 - share)
        ratio[~telling | (a + b < LEAST_TEXTS)] = 0
        x = x.take(np.arange(len(y)), ratio != 0)
        used, at = np.unique(x.at, return_inverse=True)
        scale = ratio[used]
        value = scale[at]
        w, gw, gv, gb = np.zeros(len(used)), np.full(len(used), 1e-12), np.full_like(self.v, 1e-12), 1e-12
        self.b = float(np.log((yes + 1) / (no + 1)))
        for _ in range(rounds):
            margin = np.bincount(x.row, w[at] * value, len(y)) + x.extra @ self.v + self.b
            off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / max(len(y), 1)
            dw = np.bincount(at, off[x.row] * value, len(used)) + ridge * w
            dv, db = x.extra.T @ off + ridge * self.v, off.sum()
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            self.v = self.v - rate * dv / np.sqrt(gv)
            self.b -= rate * db / np.sqrt(gb)
        self.w[used] = w * scale
        return self


class Chain:
    """Models of the categories in order."""

    def __init__(self, categories: Sequence[str], features: int = FEATURES) -> None:
        self.categories = list(categories)
        self.features = features
        self.models: list[Linear] = []
        self.cuts: list[float] = []

    def fit(self, rows: Sequence[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> Chain:
        """labels: a row of 0 and 1 for each row of features, a column for each category."""
        n = len(rows)
        x = Rows(rows, np.zeros((n, 0)))
        fold = np.arange(n) % folds
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            out = np.zeros(n)
            for f in range(folds):
                mine, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                if len(mine):
                    out[mine] = Linear(self.features, k).fit(x.take(rest), y[rest]).probabilities(x.take(mine))
            self.models.append(Linear(self.features, k).fit(x, y))
            self.cuts.append(_best_cut(out, y))
            x.extra = np.column_stack([x.extra, out])
        return self

    def predict(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each category."""
        x = Rows(rows, np.zeros((len(rows), 0)))
        for m in self.models:
            x.extra = np.column_stack([x.extra, m.probabilities(x)])
        return x.extra


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut, at 0.5 or above, with the best F1 on out-of-fold probabilities."""
    cuts = np.linspace(0.5, 0.98, 25)
    f1 = [2 * (y[p >= c].sum()) / max((p >= c).sum() + y.sum(), 1) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(cuts[best[len(best) // 2]])


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: Sequence[str], most: int = FIT_ROWS) -> Chain:
    """A chain fitted on at most `most` labelled rows, those with the smallest hash of id and text.

    categories are label columns of 0 and 1. Rows with a null text or a null label teach nothing; repeated
    rows teach once, and of several label rows of an id the largest labels hold. Without labelled rows
    every probability is one half and no row reaches a cut. At most `most` feature sets of whole texts
    reach the driver.
    """
    ys = [f"y{k}" for k in range(len(categories))]
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null").withColumn("h", F.xxhash64("id", "t"))
    y = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(k) for k, c in zip(ys, categories, strict=True))).dropna()
    y = y.groupBy("id").agg(*(F.max(k).alias(k) for k in ys))
    chosen = x.select("id", "h").distinct().join(y, "id").orderBy("h", "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for b in batches:
            rows = pa.array([hashed(t).astype(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows, b.column(2)], names=["h", "x", "y"])

    # A table of `most` rows at most, by its limit.
    met = x.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"]).select("h", "t", F.array(*ys).alias("y"))
    rows = met.mapInArrow(run, "h long, x array<int>, y array<int>").toArrow().sort_by("h")
    chain = Chain(categories)
    if not rows.num_rows:
        chain.models = [Linear(FEATURES, k) for k in range(len(categories))]
        chain.cuts = [0.75] * len(categories)
        return chain
    sets = [s.values.to_numpy().astype(np.int64) for s in rows["x"]]
    return chain.fit(sets, np.array(rows["y"].to_pylist()))


def with_toxicity(df: DataFrame, text_col: str, chain: Chain, target: str) -> DataFrame:
    """All columns of df, then p_<category> for each category and toxic, whether target's reaches its cut.

    Null, empty and wordless texts get the models' probabilities for no words and are never toxic.
    Whole texts count. Repeated rows stay, each with the same outcome. Columns of the new names in df are
    replaced.
    """
    new = [f"p_{c}" for c in chain.categories]
    df = df.drop(*new, "toxic")
    at = chain.categories.index(target)
    model = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, hashed = model.value, Hasher()
        for x in slices(batches, STEP_ROWS):
            rows = [hashed(t) for t in x.column(text_col).cast(pa.string()).to_pylist()]
            p = fitted.predict(rows)
            words = np.array([len(r) > 0 for r in rows], bool)
            toxic = (p[:, at] >= fitted.cuts[at]) & words
            cols = [pa.array(p[:, k].copy()) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*x.columns, *cols, pa.array(toxic)], names=[*x.schema.names, *new, "toxic"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*fields, *(f"`{c}` double" for c in new), "toxic boolean"]))
