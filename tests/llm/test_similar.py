"""Near copies: how many pairs are asked for, and what they are grouped into."""

from __future__ import annotations

import random

from tessera.llm import similar


def test_pairs_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies with a run of 14 words of their own in 400 over 20 words, whose fingerprints are far apart, and texts without a copy."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    common = [word() for _ in range(20)]
    base, copies = rng.choices(common, k=400), []
    for _ in range(150):
        at = rng.randrange(387)
        copies.append(" ".join(base[:at] + [word() for _ in range(14)] + base[at + 14 :]))
    others = [" ".join(word() for _ in range(50)) for _ in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(copies + others)], "id int, text string")
    asked, plain = [], similar.map_filtered
    monkeypatch.setattr(similar, "map_filtered", lambda pairs, *more: asked.append(pairs.count()) or plain(pairs, *more))
    got = sorted(r.id for r in similar.one_of_each(rows, "id", "text").collect())
    assert got == [0, *range(150, 170)]
    # All pairs of the group are 11,175; the first index gives one partner a text and posting, 16 at most.
    assert sum(asked[1:]) < 6 * len(copies)
