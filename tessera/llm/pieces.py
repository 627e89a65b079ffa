"""SentencePiece encoding and decoding by a table of distinct marked words.

In a BPE piece model where no piece has the white-space mark after another character, merges never
cross a mark, so a text is a sequence of marked words (a run of marks and what follows it) and each
distinct word is segmented once. Ids join back to texts by position. The same holds for decoding: a
word's pieces decode to that word, and words are joined by the space their first mark stands for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of words that a task's table holds before it starts anew; results do not depend on it.
TABLE_CHARS = 16_000_000
#: Longer words are segmented when met and are not kept.
LONG_WORD = 1000

_MARK = "▁"
# Spaces and the word after them; the library puts a space in front of each text.
_RUN = re.compile(r" +[^ ]*")


class WordTable:
    """Distinct marked words of a task with their ids, counts and decoded forms."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        size = self.model.get_piece_size()
        if any(_MARK in self.model.id_to_piece(i).lstrip(_MARK) for i in range(size)):
            raise ValueError("the model has pieces that cross a white-space mark")
        probe = " a \téﬁ  bⅣ "
        if self.model.normalize(probe) != _MARK + probe.replace(" ", _MARK):
            raise ValueError("the model's normaliser changes texts")
        self.words: dict[str, tuple[str, int, str]] = {}
        self.chars = 0

    def look_up(self, word: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded form) of a word without its first mark."""
        if (found := self.words.get(word)) is not None:
            return found
        # A lone mark is the space that ends a text; the library encodes the empty text to no ids.
        ids = self.model.encode(word) if word else [self.model.piece_to_id(_MARK)]
        found = (",".join(map(str, ids)), len(ids), self.model.decode(ids))
        if len(word) < LONG_WORD:
            if self.chars > TABLE_CHARS:
                self.words.clear()
                self.chars = 0
            self.words[word] = found
            self.chars += len(word) + 64
        return found

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        get, look = self.words.get, self.look_up
        found = [get(w) or look(w) for w in split_words(text)]
        return ",".join([x[0] for x in found if x[1]]), sum([x[1] for x in found]), " ".join([x[2] for x in found])


def split_words(text: str) -> list[str]:
    """The marked words of a text, each without its first mark; a run of spaces belongs to the word after it."""
    text = text.replace(_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _RUN.findall(" " + text)]


@lru_cache(maxsize=2)
def _table(model: str) -> WordTable:
    return WordTable(model)


def encode_texts(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, ids array<int>) for each row: what the library's encode gives for the whole text."""
    return _encoded(df, id_col, text_col, model, "ids array<int>", lambda x: [pa.array([[int(i) for i in s.split(",")] if s else [] for s, _, _ in x], pa.list_(pa.int32()))])


def decode_texts(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, decoded string) for each row: what the library's decode gives for the ids of the whole text."""
    return _encoded(df, id_col, text_col, model, "decoded string", lambda x: [pa.array([d for _, _, d in x], pa.string())])


def encoding_digests(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row.

    Null texts count as empty: no ids, digests of the empty string. Repeated rows and null ids stay. Only
    the two named columns are read, so others cannot clash. An empty table gives an empty result. Nothing
    is shuffled; a task holds one word table of at most TABLE_CHARS characters.
    """

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def columns(x: list[tuple[str, int, str]]) -> list[pa.Array]:
        return [pa.array([n for _, n, _ in x], pa.int64()), pa.array([sha(s) for s, _, _ in x], pa.string()), pa.array([sha(d) for _, _, d in x], pa.string())]

    return _encoded(df, id_col, text_col, model, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _encoded(df: DataFrame, id_col: str, text_col: str, model: str, schema: str, columns) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                x = batch.slice(a, 500)
                found = [table.encode(t) for t in x.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.column(0), *columns(found)], names=names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {schema}")
