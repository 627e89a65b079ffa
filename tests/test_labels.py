"""Label propagation against its rounds written out."""

from tessera.operators import graph


def test_label_propagation_stops_at_a_two_cycle(spark, monkeypatch):
    """Rounds after a two-cycle are known: none is run, and the last round's labels come out for odd and even limits."""
    edges = [("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 2.0), ("c", "y", 5.0), ("d", "z", 1.0), ("d", "e", 1.0)]
    e = spark.createDataFrame(edges, "u string, v string, weight double")
    near: dict = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))

    def plain(rounds):
        now = {n: n for n in near}
        for _ in range(rounds):
            votes = {n: {} for n in near}
            for n, x in near.items():
                for m, w in x:
                    votes[n][now[m]] = votes[n].get(now[m], 0.0) + w
            now = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
        return now

    ran, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: ran.append(1) or kept(df))
    for rounds in (0, 1, 2, 30, 31):
        ran.clear()
        assert {r.id: r.label for r in graph.label_propagation(e, rounds).collect()} == plain(rounds)
        assert len(ran) < 12
