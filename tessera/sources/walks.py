"""Sources that are walked instead of paged: sites by their sitemap, tool servers, repository files, dataset rows.

As for the services, the transport (or the server's client) is injected. A walk that could not read
everything keeps what it read and is not full, so nothing is pruned after it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from typing import Protocol
from urllib.parse import quote, urljoin
from xml.etree import ElementTree

from .connectors import Fetched, Pager, Transport, at_path
from .parse import html_markdown

#: Sitemaps within sitemaps, from the first one on.
SITEMAP_DEPTH = 10
#: Rows of one request to a dataset.
ROWS_PAGE = 100


def _locations(body: str, base: str) -> tuple[list[str], list[str]]:
    """(pages, child sitemaps) of a sitemap, addresses resolved."""
    root = ElementTree.fromstring(body)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    kind = local(root)
    if kind not in ("urlset", "sitemapindex"):
        raise ValueError(f"{base} is no sitemap")
    found = [urljoin(base, (loc.text or "").strip()) for entry in root for loc in entry if local(loc) == "loc" and (loc.text or "").strip()]
    return (found, []) if kind == "urlset" else ([], found)


def sitemap_pages(transport: Transport, url: str, depth: int = 0) -> list[str]:
    """The pages of a sitemap and of those that it names, in order; one that cannot be read is an error."""
    if depth > SITEMAP_DEPTH:
        raise ValueError(f"sitemaps are nested too deep at {url}")
    pages, children = _locations(transport(url, {})[1], url)
    return pages + [p for c in children for p in sitemap_pages(transport, c, depth + 1)]


def fetch_site(transport: Transport, name: str, sitemap: str = "", pages: Sequence[str] = ()) -> Fetched:
    """A site's pages as Markdown documents, by its sitemap or by a list; full if every page could be read."""
    documents, full = [], True
    for url in sitemap_pages(transport, sitemap) if sitemap else pages:
        try:
            title, body = html_markdown(transport(url, {})[1], url)[:2]
        except Exception:
            full = False
            continue
        documents.append({"source": name, "id": url, "kind": "page", "title": title, "url": url, "body": body})
    return Fetched(documents, "", full)


class ToolServer(Protocol):
    def resources(self) -> Sequence[dict]: ...

    def read(self, uri: str) -> Sequence[dict]: ...

    def tools(self) -> Sequence[dict]: ...


def fetch_tool_server(server: ToolServer, name: str) -> Fetched:
    """A tool server's resources (uri, name) and tools (name, description, inputSchema) as documents; full if every resource could be read."""
    documents, full = [], True
    for r in server.resources():
        try:
            body = "\n\n".join(c["text"] for c in server.read(r["uri"]) if c.get("text"))
        except Exception:
            full = False
            continue
        documents.append({"source": name, "id": f"{name}:{r['uri']}", "kind": "resource", "title": r.get("name") or r["uri"], "url": r["uri"], "body": body})
    for t in server.tools():
        schema = json.dumps(t.get("inputSchema") or {}, sort_keys=True, ensure_ascii=False)
        documents.append({"source": name, "id": f"{name}:tool:{t['name']}", "kind": "tool", "title": t["name"], "url": None, "body": f"{t.get('description') or ''}\n\n{schema}".strip()})
    return Fetched(documents, "", full)


def fetch_repository(transport: Transport, name: str, repo: str, branch: str = "main", prefixes: Sequence[str] = ("",), endings: Sequence[str] = (".md",), api: str = "https://api.github.com") -> Fetched:
    """A repository's files under some prefixes and of some endings, as they stand on a branch; full if all could be listed and read."""
    tree = json.loads(transport(f"{api}/repos/{repo}/git/trees/{quote(branch, safe='')}", {"recursive": "1"})[1])
    documents, full = [], not tree.get("truncated")
    for e in tree.get("tree") or ():
        path = e.get("path", "")
        if e.get("type") != "blob" or not path.startswith(tuple(prefixes)) or not path.endswith(tuple(endings)):
            continue
        try:
            item = json.loads(transport(f"{api}/repos/{repo}/contents/{quote(path)}", {"ref": branch})[1])
            body = base64.b64decode(item["content"]).decode("utf-8", "replace")
        except Exception:
            full = False
            continue
        documents.append({"source": name, "id": path, "kind": "file", "title": path.rsplit("/", 1)[-1], "url": item.get("html_url"), "body": body})
    return Fetched(documents, "", full)


def dataset_rows(transport: Transport, base: str, dataset: str, config: str = "default", split: str = "train") -> Iterator[dict]:
    """The rows of a hosted dataset, page by page to the last."""
    pager = Pager("offset", "offset", "num_rows_total", ROWS_PAGE)
    step = (f"{base}/rows", {"dataset": dataset, "config": config, "split": split, "offset": "0", "length": str(ROWS_PAGE)})
    while step is not None:
        headers, body = transport(*step)
        page = json.loads(body)
        yield from (r["row"] for r in at_path(page, "rows") or ())
        step = pager.following(*step, headers, page)


def public_ids(rows: Iterator[dict]) -> dict[str, str]:
    """The private id of each public one, as texts."""
    return {str(r["public_id"]): str(r["id"]) for r in rows}
