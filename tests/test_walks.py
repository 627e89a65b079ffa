"""Sites, tool servers, repositories and datasets from recorded answers."""

import base64
import json

import pytest

from tessera.sources.connectors import SERVICES, fetch
from tessera.sources.walks import dataset_rows, fetch_repository, fetch_site, fetch_tool_server, public_ids, sitemap_pages

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SITE = {
    "https://s/map.xml": f"<sitemapindex {NS}><sitemap><loc>/one.xml</loc></sitemap><sitemap><loc>two.xml</loc></sitemap></sitemapindex>",
    "https://s/one.xml": f"<urlset {NS}><url><loc> /a </loc><lastmod>2024-01-01</lastmod></url></urlset>",
    "https://s/two.xml": f"<urlset {NS}><url><loc>https://s/b</loc></url><url><loc></loc></url></urlset>",
    "https://s/a": "<html><head><title>A</title></head><body><p>first</p></body></html>",
    "https://s/b": "<html><body><p>second</p></body></html>",
    "https://s/loop.xml": f"<sitemapindex {NS}><sitemap><loc>/loop.xml</loc></sitemap></sitemapindex>",
    "https://s/none.xml": "<html/>",
}


def site(url, params):
    return {}, SITE[url]


def test_sitemaps():
    assert sitemap_pages(site, "https://s/map.xml") == ["https://s/a", "https://s/b"]
    got = fetch_site(site, "web", "https://s/map.xml")
    assert [d["id"] for d in got.documents] == ["https://s/a", "https://s/b"] and "first" in got.documents[0]["body"] and got.full
    # A page that cannot be read is left out, and then nothing is to be pruned.
    part = fetch_site(site, "web", pages=["https://s/a", "https://s/gone"])
    assert len(part.documents) == 1 and not part.full
    for bad in ("https://s/loop.xml", "https://s/none.xml"):
        with pytest.raises(ValueError):
            sitemap_pages(site, bad)
    with pytest.raises(KeyError):
        fetch_site(site, "web", "https://s/missing.xml")


class Server:
    def resources(self):
        return [{"uri": "u:1", "name": "One"}, {"uri": "u:2"}]

    def read(self, uri):
        if uri == "u:2":
            raise OSError("gone")
        return [{"text": "a"}, {"blob": "x"}, {"text": "b"}]

    def tools(self):
        return [{"name": "find", "description": "Finds.", "inputSchema": {"type": "object", "a": 1}}]


def test_tool_server():
    got = fetch_tool_server(Server(), "m")
    assert [(d["id"], d["kind"], d["body"]) for d in got.documents] == [("m:u:1", "resource", "a\n\nb"), ("m:tool:find", "tool", 'Finds.\n\n{"a": 1, "type": "object"}')]
    assert not got.full


@pytest.mark.parametrize("truncated", [False, True])
def test_repository(truncated):
    def transport(url, params):
        if "/git/trees/" in url:
            assert url.endswith("/feature%2Fx") and params == {"recursive": "1"}
            return {}, json.dumps({"truncated": truncated, "tree": [{"path": p, "type": t} for p, t in (("docs/a b.md", "blob"), ("docs", "tree"), ("docs/x.png", "blob"), ("src/c.md", "blob"))]})
        assert url.endswith("/contents/docs/a%20b.md")
        return {}, json.dumps({"content": base64.b64encode("héllo".encode()).decode(), "html_url": "h"})

    got = fetch_repository(transport, "repo", "o/r", "feature/x", ["docs/"])
    assert [(d["id"], d["body"]) for d in got.documents] == [("docs/a b.md", "héllo")] and got.full is not truncated


def test_dataset_rows():
    every = [{"id": k, "public_id": k + 1000} for k in range(250)]

    def transport(url, params):
        at = int(params["offset"])
        return {}, json.dumps({"rows": [{"row": r} for r in every[at : at + int(params["length"])]], "num_rows_total": len(every)})

    assert list(dataset_rows(transport, "https://d", "x")) == every
    assert public_ids(dataset_rows(transport, "https://d", "x"))["1249"] == "249"


def test_merge_requests_page_by_header():
    def transport(url, params):
        n = int(params.get("page", 1))
        return {"X-Next-Page": "2" if n == 1 else ""}, json.dumps([{"iid": n, "title": "t", "updated_at": f"2024-01-0{n}T00:00:00+00:00", "description": "d"}])

    got = fetch(SERVICES["gitlab-merge-requests"], transport, {"base": "https://g", "project": "1"})
    assert [d["id"] for d in got.documents] == ["1", "2"] and got.full and got.cursor.startswith("2024-01-02")
    wiki = fetch(SERVICES["gitlab-wiki"], lambda u, p: ({}, json.dumps([{"slug": "a", "title": "A", "content": "c"}])), {"base": "https://g", "project": "1"}, "old")
    assert wiki.full and wiki.documents[0]["body"] == "c"
