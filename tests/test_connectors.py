"""Services over several recorded pages: everything is listed, cursors are of the service's kind, cut listings prune nothing."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources.connectors import SERVICES, fetch, fetch_many
from tessera.streaming.ingest import sync

CONFIG = {"base": "https://x", "channel": "c", "token": "t", "board": "b", "repo": "r", "project": "p"}
N = 230


def item(name: str, k: int) -> dict:
    return {
        "telegram": {"update_id": 1000 + k, "message": {"from": {"username": "u"}, "date": k, "text": f"t{k}"}},
        "mattermost": {"id": f"m{k}", "user_id": "u", "update_at": 10**12 + k, "message": f"t{k}"},
        "discord": {"id": str(10**17 + k), "author": {"username": "u"}, "timestamp": f"2024-01-01T00:00:{k % 60:02}", "content": f"t{k}"},
        "youtrack": {"idReadable": f"A-{k}", "summary": "s", "updated": 10**12 + k, "description": f"t{k}"},
        "kaiten": {"id": k, "title": "s", "updated": f"2024-01-01T00:{k // 60:02}:{k % 60:02}", "description": f"t{k}"},
        "weeek": {"id": k, "title": "s", "updatedAt": "2024-01-01", "description": f"t{k}"},
    }[name]


def service_of(name: str, calls: list):
    """A transport that answers as the service pages: by number, by offset, or from an id on."""
    every = [item(name, k) for k in range(N)]

    def transport(url: str, params: dict) -> tuple[dict, str]:
        calls.append(dict(params))
        if name == "telegram":
            return {}, json.dumps({"result": [x for x in every if x["update_id"] >= int(params.get("offset", 0))][:100]})
        if name == "discord":
            return {}, json.dumps([x for x in every if int(x["id"]) > int(params["after"])][:100][::-1])
        size = int(params.get("per_page") or params.get("limit") or params.get("perPage") or params.get("$top"))
        at = int(params["page"]) * size if name == "mattermost" else int(params.get("offset") or params.get("$skip") or 0)
        part = every[at : at + size]
        return {}, json.dumps({"posts": {x["id"]: x for x in part}} if name == "mattermost" else {"tasks": part} if name == "weeek" else part)

    return transport


@pytest.mark.parametrize("name", ["telegram", "mattermost", "discord", "youtrack", "kaiten", "weeek"])
def test_all_pages_are_listed(name):
    calls: list = []
    got = fetch(SERVICES[name], service_of(name, calls), CONFIG)
    assert [len({d["id"] for d in got.documents}), len(got.documents)] == [N, N] and len(calls) >= 2
    assert got.full == (SERVICES[name].reconcile != "never")


def test_cursors_are_of_the_services_kind():
    calls: list = []
    got = {n: fetch(SERVICES[n], service_of(n, calls), CONFIG).cursor for n in ("telegram", "mattermost", "discord", "youtrack", "kaiten")}
    assert got == {"telegram": str(1000 + N), "mattermost": str(10**12 + N - 1), "discord": str(10**17 + N - 1), "youtrack": str(10**12 + N - 1), "kaiten": "2024-01-01T00:03:49"}
    for n in ("telegram", "discord"):
        again = fetch(SERVICES[n], service_of(n, calls), CONFIG, got[n])
        assert (again.documents, again.cursor, again.full) == ([], got[n], False)
    calls.clear()
    fetch(SERVICES["youtrack"], service_of("youtrack", calls), CONFIG, "1700000000000")
    assert calls[0]["query"] == "updated: 1700000000000 .. *"
    # Numbers of different lengths compare as numbers.
    one = fetch(SERVICES["mattermost"], lambda u, p: ({}, json.dumps({"posts": [{"id": "a", "update_at": 99}, {"id": "b", "update_at": 100}]})), CONFIG)
    assert one.cursor == "100"


def test_a_cut_listing_is_not_full():
    cards = [{"id": str(k), "name": "n", "dateLastActivity": "2024-01-01"} for k in range(1000)]
    assert not fetch(SERVICES["trello"], lambda u, p: ({}, json.dumps(cards)), CONFIG).full
    assert fetch(SERVICES["trello"], lambda u, p: ({}, json.dumps(cards[:999])), CONFIG).full


def test_sync_prunes_only_after_whole_listings(spark):
    cards = json.dumps([{"id": str(k), "name": "n", "dateLastActivity": "2024-01-01"} for k in range(1000)])
    tasks = json.dumps({"tasks": [{"id": k, "title": "s"} for k in range(3)]})

    def transport(url: str, params: dict) -> tuple[dict, str]:
        return {}, cards if "trello" in url else tasks

    fetched = fetch_many(spark, [("board", "trello", CONFIG, ""), ("todo", "weeek", CONFIG, "")], transport)
    indexed = spark.createDataFrame([("board", "old"), ("todo", "old"), ("todo", "1")], "source string, id string")
    none = spark.createDataFrame([], "source string, id string")
    documents, pruned, _ = sync(fetched, none.select("source", F.lit("").alias("cursor")), indexed, none)
    assert documents.count() == 1003
    assert {tuple(r) for r in pruned.select("source", "id").collect()} == {("todo", "old")}
