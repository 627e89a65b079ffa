"""License scans: short notices found in whole texts with a bounded number of edits.

A notice of k permitted edits is cut into k + 1 seeds. Whatever is at most k edits away from the notice leaves
one seed untouched (k edits cannot reach k + 1 seeds), so the places of the seeds, found for all notices at
once, are a complete list of candidates. Around each the regex library matches the notice with bounded
errors, and reports the best span and its edits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices
from .wordbytes import words

#: Windows whose verdict a task remembers; results do not depend on it.
REMEMBERED = 1 << 14


class Notice(NamedTuple):
    """A phrase of lower-cased words, its label, how many edits of characters it may have, and whether its exact places are base ones."""

    phrase: str
    label: str
    edits: int
    base: bool = False


class Found(NamedTuple):
    """A notice's place: its number, first and last word (counted from 0), and its edits."""

    notice: int
    first: int
    last: int
    edits: int


#: The phrases and labels that a scan has to know.
BASE = (
    Notice("gnu general public license", "gpl", 2, True),
    Notice("apache license", "apache", 1, True),
    Notice("cc by", "cc-by", 0, True),
    Notice("mit license", "mit", 1, True),
)
#: Openings and names of further public licenses.
FURTHER = (
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("mozilla public license", "mpl", 1),
    Notice("eclipse public license", "epl", 1),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("all rights reserved", "proprietary", 1),
)


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, text) of edits + 1 parts of the phrase, of about one length."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """All notices' seeds in one automaton, and their patterns with bounded errors."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        import ahocorasick
        import regex

        self.notices = list(notices)
        at: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for n, x in enumerate(self.notices):
            if b" ".join(words(x.phrase.encode())).decode() != x.phrase or x.edits < 0 or len(x.phrase) <= 2 * x.edits + 1:
                raise ValueError(f"a notice has lower-cased words parted by single spaces, and few edits for its length: {x}")
            for offset, seed in seeds(x.phrase, x.edits):
                at.setdefault(seed, []).append((n, offset))
            # The spaces around are matched exactly, so that spans begin and end with words.
            self.patterns.append(regex.compile(rf"(?b)(?<= )(?:{regex.escape(x.phrase, literal_spaces=True)}){{e<={x.edits}}}(?= )"))
        self.seeds = ahocorasick.Automaton()
        for seed, where in at.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()
        self.verdict = lru_cache(REMEMBERED)(self._verdict)

    def _verdict(self, n: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice's best match in a window."""
        m = self.patterns[n].search(window)
        if m is None:
            return None
        # An edit at the rim may take in a space; the span is that of the words.
        a = m.start() + len(m[0]) - len(m[0].lstrip(" "))
        return a, m.end() - (len(m[0]) - len(m[0].rstrip(" "))), sum(m.fuzzy_counts)

    def scan(self, text: bytes) -> tuple[int, list[Found]]:
        """(number of words, places by first word) of a text's UTF-8 bytes; a notice's overlapping places are one, that of fewest edits."""
        parts = words(text)
        if not parts:
            return 0, []
        line = f" {b' '.join(parts).decode('utf-8', 'replace')} "
        expected = set()
        for end, (size, where) in self.seeds.iter(line):
            expected.update((n, end + 1 - size - offset) for n, offset in where)
        matches = set()
        for n, start in expected:
            x = self.notices[n]
            lo = max(0, start - x.edits - 1)
            best = self.verdict(n, line[lo : max(0, start + len(x.phrase) + x.edits + 1)])
            if best is not None:
                matches.add((n, best[2], lo + best[0], lo + best[1]))
        taken: dict[int, list[tuple[int, int]]] = {}
        kept = []
        for n, edits, a, b in sorted(matches):
            # Exact places never overlap places kept before them but exact ones, and stay whatever overlaps.
            if edits and any(a < d and c < b for c, d in taken.get(n, ())):
                continue
            taken.setdefault(n, []).append((a, b))
            kept.append((a, b, n, edits))
        kept.sort()
        found, word, seen = [], 0, 1
        for a, b, n, edits in kept:
            word += line.count(" ", seen, a)
            seen = a
            found.append(Found(n, word, word + line.count(" ", a, b), edits))
        return len(parts), found


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_notices(df: DataFrame, id_col: str, text_col: str, notices: Sequence[Notice] = BASE + FURTHER) -> DataFrame:
    """(id, n_words, spans) for each row; a span has label, phrase, first_word, last_word, edits, exact and base.

    Texts are taken whole, A-Z lower-cased; words are runs of digits, letters and characters beyond ASCII, and
    whatever stands between them counts as one space. A null or empty text has no words and no spans. Repeated
    rows and null ids stay. Only the two named columns are read, so others cannot clash; an empty table gives an
    empty result. Every place within a notice's edits is a candidate; of a notice's overlapping places the one
    of fewest edits (then the first) is reported, exact places always. Spans come by first word. Nothing is
    shuffled, and a task holds one batch of texts.
    """
    kind = df.schema[id_col].dataType.simpleString()
    chosen = tuple(notices)
    span = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(chosen)

        def told(x: Found) -> dict:
            y = chosen[x.notice]
            return {"label": y.label, "phrase": y.phrase, "first_word": x.first, "last_word": x.last, "edits": x.edits, "base": y.base and x.edits == 0}

        for x in slices(batches, 200):
            counts, rows = [], []
            for text in x.column(1).cast(pa.large_binary()):
                n, found = scanner.scan(text.as_py() or b"")
                counts.append(n)
                rows.append([told(y) for y in found])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(span))], names=["id", "n_words", "spans"])

    schema = f"id {kind}, n_words long, spans array<struct<label string, phrase string, first_word long, last_word long, edits int, base boolean>>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def license_report(scanned: DataFrame) -> DataFrame:
    """One row for each row of scan_notices: counts and ends of the base places, labels, and a score.

    score is the largest share of a notice's characters that stand unedited, 0 without a span; labels are
    distinct, sorted and joined by commas.
    """
    base = F.filter("spans", lambda x: x["base"])

    def joined(x):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")

    share = F.transform("spans", lambda x: F.lit(1.0) - x["edits"] / F.length(x["phrase"]))
    return scanned.select(
        "id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )
