"""Connectors to services: paged requests through an injected transport, turned into documents.

A service is a specification: where its pages are, how the next page is found, where items and their
fields lie, what the cursor becomes and when a fetch has seen everything. The transport is a function
(url, params) -> (headers, body), so tests and offline use give it recorded pages. fetch() runs in one
place for one source; fetch_many() spreads sources over tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Transport = Callable[[str, dict[str, str]], tuple[dict[str, str], str]]


def at_path(x: object, path: str) -> object:
    """The value at a.b.0.c of parsed JSON, or None."""
    for p in path.split(".") if path else ():
        if isinstance(x, dict):
            x = x.get(p)
        elif isinstance(x, list) and p.isdigit() and int(p) < len(x):
            x = x[int(p)]
        else:
            return None
    return x


@dataclass(frozen=True)
class Pager:
    """How a next page is found: link, header, cursor, next, offset, window, page, skip, last or none.

    page and skip count pages and items on while a page holds `size` items; last asks from the largest
    number at `path` of a page's items on, while pages hold any. none with a size is a listing of one page
    that may hold more than it shows when it is full.
    """

    kind: str = "none"
    param: str = ""
    path: str = ""
    size: int = 0
    step: timedelta = timedelta(0)
    until: datetime | None = None

    def following(self, url: str, params: dict[str, str], headers: dict[str, str], body: object, items: Sequence[object] = ()) -> tuple[str, dict[str, str]] | None:
        if self.kind in ("page", "skip"):
            now = int(params.get(self.param, 0)) + (1 if self.kind == "page" else self.size)
            return (url, params | {self.param: str(now)}) if len(items) >= self.size else None
        if self.kind == "last":
            seen = [int(v) for x in items if str(v := at_path(x, self.path)).isdigit()]
            now = max(seen, default=0) + self.size
            return (url, params | {self.param: str(now)}) if seen and now > int(params.get(self.param, -1)) else None
        low = {k.lower(): v for k, v in headers.items()}
        if self.kind == "link":
            m = re.search(r'<([^>]+)>\s*;[^,]*\brel\s*=\s*"?next"?', low.get("link", ""))
            return (m[1], {}) if m else None
        if self.kind == "header":
            v = low.get(self.path.lower(), "")
            return (url, params | {self.param: v}) if v else None
        if self.kind == "cursor":
            v = at_path(body, self.path)
            return (url, params | {self.param: str(v)}) if v not in (None, "") else None
        if self.kind == "next":
            v = at_path(body, self.path)
            return (urljoin(url, str(v)), {}) if v else None
        if self.kind == "offset":
            total = at_path(body, self.path)
            now = int(params.get(self.param, 0)) + self.size
            return (url, params | {self.param: str(now)}) if isinstance(total, int) and now < total else None
        if self.kind == "window":
            now = datetime.fromisoformat(params[self.param]) + self.step
            return (url, params | {self.param: now.isoformat()}) if self.until and now < self.until else None
        return None


@dataclass(frozen=True)
class Service:
    """Where a service's documents are. fields maps document columns to paths in an item."""

    name: str
    url: str
    items: str
    fields: dict[str, str]
    pager: Pager = field(default_factory=Pager)
    since: str = ""
    back: timedelta = timedelta(0)
    params: dict[str, str] = field(default_factory=dict)
    #: always, empty (only without a cursor) or never: whether a fetch lists everything there is.
    reconcile: str = "empty"
    kind: str = "page"
    #: The path in an item of what the cursor becomes, and whether that is a number; updated_at else.
    mark: str = ""
    number: bool = False
    #: How the cursor is written into `since`.
    asks: str = "{cursor}"


# The services' public interfaces and where their answers hold what.
SERVICES = {
    s.name: s
    for s in (
        Service("github", "https://api.github.com/repos/{repo}/issues", "", {"id": "number", "title": "title", "url": "html_url", "updated_at": "updated_at", "body": "body"}, Pager("link"), "since", timedelta(seconds=1), {"state": "all", "per_page": "100"}, kind="issue"),
        Service("gitlab", "{base}/api/v4/projects/{project}/issues", "", {"id": "iid", "title": "title", "url": "web_url", "updated_at": "updated_at", "body": "description"}, Pager("header", "page", "X-Next-Page"), "updated_after", timedelta(seconds=1), {"per_page": "100"}, kind="issue"),
        Service("gitlab-merge-requests", "{base}/api/v4/projects/{project}/merge_requests", "", {"id": "iid", "title": "title", "url": "web_url", "updated_at": "updated_at", "body": "description"}, Pager("header", "page", "X-Next-Page"), "updated_after", timedelta(seconds=1), {"scope": "all", "state": "all", "per_page": "100"}, kind="merge-request"),
        Service("gitlab-wiki", "{base}/api/v4/projects/{project}/wikis", "", {"id": "slug", "title": "title", "body": "content"}, Pager(), params={"with_content": "1"}, reconcile="always"),
        Service("mediawiki", "{base}/api.php", "query.pages", {"id": "pageid", "title": "title", "updated_at": "revisions.0.timestamp", "body": "revisions.0.slots.main.*"}, Pager("cursor", "grccontinue", "continue.grccontinue"), "grcend", timedelta(0), {"action": "query", "generator": "recentchanges", "prop": "revisions", "rvprop": "content|timestamp", "rvslots": "main", "format": "json"}, "never"),
        Service("confluence", "{base}/rest/api/content/search", "results", {"id": "id", "title": "title", "url": "_links.webui", "updated_at": "version.when", "body": "body.storage.value"}, Pager("next", path="_links.next"), "cql", params={"expand": "body.storage,version"}, asks='lastmodified >= "{cursor}"'),
        Service("slack", "https://slack.com/api/conversations.history", "messages", {"id": "ts", "title": "user", "updated_at": "ts", "body": "text"}, Pager("cursor", "cursor", "response_metadata.next_cursor"), "oldest", kind="message"),
        Service("telegram", "https://api.telegram.org/bot{token}/getUpdates", "result", {"id": "update_id", "title": "message.from.username", "updated_at": "message.date", "body": "message.text"}, Pager("last", "offset", "update_id", 1), "offset", params={"limit": "100"}, reconcile="never", kind="message", mark="update_id", number=True),
        Service("mattermost", "{base}/api/v4/channels/{channel}/posts", "posts", {"id": "id", "title": "user_id", "updated_at": "update_at", "body": "message"}, Pager("page", "page", size=200), "since", params={"page": "0", "per_page": "200"}, kind="message", mark="update_at", number=True),
        Service("discord", "https://discord.com/api/v10/channels/{channel}/messages", "", {"id": "id", "title": "author.username", "updated_at": "timestamp", "body": "content"}, Pager("last", "after", "id"), "after", params={"after": "0", "limit": "100"}, kind="message", mark="id", number=True),
        Service("yandex-tracker", "https://api.tracker.yandex.net/v2/issues/_search", "", {"id": "key", "title": "summary", "updated_at": "updatedAt", "body": "description"}, Pager("link"), "updated.from", kind="issue"),
        Service("youtrack", "{base}/api/issues", "", {"id": "idReadable", "title": "summary", "updated_at": "updated", "body": "description"}, Pager("skip", "$skip", size=100), "query", params={"$top": "100", "$skip": "0", "fields": "idReadable,summary,description,updated"}, kind="issue", mark="updated", number=True, asks="updated: {cursor} .. *"),
        Service("kaiten", "{base}/api/latest/cards", "", {"id": "id", "title": "title", "updated_at": "updated", "body": "description"}, Pager("skip", "offset", size=100), "updated_after", params={"limit": "100", "offset": "0"}, kind="card"),
        Service("weeek", "https://api.weeek.net/public/v1/tm/tasks", "tasks", {"id": "id", "title": "title", "updated_at": "updatedAt", "body": "description"}, Pager("skip", "offset", size=100), params={"perPage": "100", "offset": "0"}, reconcile="always", kind="task"),
        Service("trello", "https://api.trello.com/1/boards/{board}/cards", "", {"id": "id", "title": "name", "url": "shortUrl", "updated_at": "dateLastActivity", "body": "desc"}, Pager(size=1000), params={"limit": "1000"}, reconcile="always", kind="card"),
        Service("search-api", "{base}", "{items}", {}, Pager(), "since"),
    )
}


@dataclass
class Fetched:
    documents: list[dict]
    cursor: str
    full: bool


def fetch(service: Service, transport: Transport, config: dict[str, str], cursor: str = "", source: str = "") -> Fetched:
    """All documents since the cursor. A page that cannot be had is an error, and the old cursor stays valid.

    full tells that everything there is was listed: never where the last page was full and no next one known.
    """
    url = service.url.format_map(config)
    params = dict(service.params)
    if cursor and service.since:
        since = cursor
        if service.back:
            since = (datetime.fromisoformat(cursor.replace("Z", "+00:00")) - service.back).isoformat()
        params[service.since] = service.asks.format(cursor=since)
    order = (lambda c: int(c) if c.isdigit() else -1) if service.number else str
    documents, newest, many = [], cursor, 0
    step: tuple[str, dict[str, str]] | None = (url, params)
    while step is not None:
        headers, body = transport(*step)
        page = json.loads(body)
        items = at_path(page, service.items.format_map(config)) if service.items else page
        items = list(items.values() if isinstance(items, dict) else items or ())
        for item in items:
            d = {k: at_path(item, p) for k, p in service.fields.items()}
            d = {k: v if v is None else str(v) for k, v in d.items()} | {"source": source or service.name, "kind": service.kind}
            documents.append(d)
            mark = at_path(item, service.mark) if service.mark else d.get("updated_at")
            newest = max(newest, str(mark if mark is not None else ""), key=order)
        many = len(items)
        step = service.pager.following(*step, headers, page, items)
    cut = service.pager.kind == "none" and 0 < service.pager.size <= many
    if service.number and service.pager.kind == "last" and newest.isdigit() and newest != cursor:
        # The next fetch asks from behind the last one.
        newest = str(int(newest) + service.pager.size)
    return Fetched(documents, newest, not cut and (service.reconcile == "always" or (service.reconcile == "empty" and not cursor)))


FETCHED = "source string, id string, kind string, title string, url string, updated_at string, body string, cursor string, full boolean, error string"


def fetch_many(spark: SparkSession, sources: Sequence[tuple[str, str, dict[str, str], str]], transport: Transport, parallel: int = 4) -> DataFrame:
    """Documents of several sources (name, service, config, cursor), a task for some of them each.

    A source that fails is one row with its error and its old cursor. Every source has one row at least.
    """
    rows = [(n, s, json.dumps(c), k) for n, s, c, k in sources]
    x = spark.createDataFrame(rows, "name string, service string, config string, cursor string").repartition(max(1, min(parallel, len(rows))), "name")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FETCHED.split(", ")]
        for f in frames:
            for r in f.itertuples():
                try:
                    got = fetch(SERVICES[r.service], transport, json.loads(r.config), r.cursor, r.name)
                    out = [d | {"cursor": got.cursor, "full": got.full} for d in got.documents] or [{"source": r.name, "cursor": got.cursor, "full": got.full}]
                except Exception as e:
                    out = [{"source": r.name, "cursor": r.cursor, "full": False, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(out).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return x.mapInPandas(run, FETCHED)
