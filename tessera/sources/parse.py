"""Parsers from file contents to documents, plain functions that the readers run in tasks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

RESERVED = ("id", "source", "kind", "title", "url", "updated_at", "visibility", "summary")


def frontmatter(text: str) -> tuple[dict[str, str], dict[str, str], str]:
    """(reserved fields, further fields, body) of a text with a `---` block; flat keys and lists in brackets.

    A text without a block has no fields. An updated_at that is no time is an error.
    """
    text = text.removeprefix("\ufeff")
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, {}, text
    known: dict[str, str] = {}
    rest: dict[str, str] = {}
    key = None
    for line in m[1].splitlines():
        if (item := re.match(r"\s*-\s+(.*)$", line)) and key is not None and not re.match(r"[^\s:]+:", line):
            into = known if key in RESERVED else rest
            into[key] = (into[key] + " " if into[key] else "") + _unquoted(item[1])
        elif pair := re.match(r"([A-Za-z0-9_.\-]+):\s*(.*)$", line):
            key = pair[1]
            (known if key in RESERVED else rest)[key] = _unquoted(pair[2])
    if known.get("updated_at"):
        datetime.fromisoformat(known["updated_at"].replace("Z", "+00:00"))
    return known, rest, text[m.end() :].lstrip("\r\n")


def _unquoted(x: str) -> str:
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] == '"':
        try:
            return json.loads(x)
        except ValueError:
            return x[1:-1]
    return x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] == "'" else x


def render(fields: dict[str, str | None], body: str) -> str:
    """A document as a text with its fields in front: reserved ones first, others by name."""
    lines = [f"{k}: {json.dumps(fields[k], ensure_ascii=False)}" for k in RESERVED if fields.get(k)]
    lines += [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(fields.items()) if k not in RESERVED and v is not None]
    return "---\n" + "\n".join(lines) + "\n---\n\n" + body.strip() + "\n"


def flat_json(raw: str) -> str:
    """Lines - `$.a.b[0]`: value of a JSON text in its order; null prints as null."""
    out: list[str] = []

    def walk(at: str, x: object) -> None:
        if isinstance(x, dict) and x:
            for k, v in x.items():
                walk(f"{at}.{k}", v)
        elif isinstance(x, list) and x:
            for i, v in enumerate(x):
                walk(f"{at}[{i}]", v)
        else:
            out.append(f"- `{at}`: {x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)}")

    walk("$", json.loads(raw))
    return "\n".join(out)


def xlsx_sheets(raw: bytes) -> list[tuple[str, str]]:
    """(name, Markdown table) of each sheet; rows padded to one width, bars escaped."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", ns)}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
        path = targets[sheet.get(f"{{{ns['r']}}}id")].lstrip("/")
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{{{ns['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                col = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    col = col * 26 + ord(ch) - 64
                while col and len(cells) < col - 1:
                    cells.append("")
                v = c.findtext("m:v", default="", namespaces=ns)
                if c.get("t") == "s" and v:
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells.append(v)
            rows.append(cells)
        out.append((sheet.get("name", ""), markdown_table(rows)))
    return out


def markdown_table(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def ddl_tables(sql: str) -> list[tuple[str, str]]:
    """(table, description) of each CREATE TABLE: columns, primary key, foreign keys."""
    sql = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", lambda m: m[0] if m[0][0] == "'" else " ", sql, flags=re.S)
    out = []
    for part in _split(sql, ";"):
        m = re.match(r"\s*create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\((.*)\)[^)]*$", part, re.I | re.S)
        if not m:
            continue
        name = re.sub(r'["`\[\]]', "", m[1])
        columns, keys, foreign = [], [], []
        for item in _split(m[2], ","):
            item = " ".join(item.split())
            if k := re.match(r"(?:constraint\s+\S+\s+)?primary\s+key\s*\((.*?)\)", item, re.I):
                keys += [c.strip(' "`') for c in k[1].split(",")]
            elif k := re.match(r"(?:constraint\s+\S+\s+)?foreign\s+key\s*\((.*?)\)\s*references\s+(\S+?)\s*\((.*?)\)", item, re.I):
                foreign.append(f"{k[1].strip()} -> {k[2]}({k[3].strip()})")
            elif not re.match(r"(?:constraint|unique|check|index|key)\b", item, re.I) and (k := re.match(r"[\"`]?([\w]+)[\"`]?\s+(.+)$", item)):
                columns.append(f"{k[1]} {k[2]}")
                if re.search(r"primary\s+key", k[2], re.I):
                    keys.append(k[1])
                if r := re.search(r"references\s+(\S+?)\s*\((.*?)\)", k[2], re.I):
                    foreign.append(f"{k[1]} -> {r[1]}({r[2].strip()})")
        lines = [f"# {name}", "", "Columns:", *(f"- {c}" for c in columns)]
        lines += ["", "Primary key: " + ", ".join(keys)] if keys else []
        lines += ["", "Foreign keys:", *(f"- {f}" for f in foreign)] if foreign else []
        out.append((name, "\n".join(lines)))
    return out


def _split(text: str, at: str) -> list[str]:
    """Parts between a mark at depth 0, outside quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == at and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (*out, text[start:]) if p.strip()]


class _Markdown(HTMLParser):
    """HTML to Markdown: headings, paragraphs, lists, links, code, quotes, tables as rows."""

    SKIP = {"script", "style", "head", "noscript", "template"}
    BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "footer", "main", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skip, self.links, self.lists, self.pre, self.title = base, [], 0, [], [], False, None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in self.BLOCK:
            self.out.append("\n\n")
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = True
            self.out.append("```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "a":
            self.links.append(urljoin(self.base, a.get("href") or "") if a.get("href") else "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({urljoin(self.base, a['src'])})")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a" and self.links:
            link = self.links.pop()
            self.out.append(f"]({link})" if link else "")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title and self.title is None and data.strip():
            self.title = data.strip()
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(html: str, base: str = "") -> tuple[str, str]:
    """(title, Markdown) of a page; links are made absolute against the base."""
    p = _Markdown(base)
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    text = re.sub(r"\n[ \t]+(?![ \t]*[-\d])", "\n", text)
    return p.title or "", re.sub(r"\n{3,}", "\n\n", text).strip()


def feed_items(xml: str) -> list[dict[str, str]]:
    """Items of an RSS or Atom feed: id, title, url, updated_at, body."""
    root = ElementTree.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    out = []
    for x in [*root.iter("item"), *root.iter("entry")]:
        link = x.findtext("link") or next((k.get("href", "") for k in x.findall("link")), "")
        body = x.findtext("encoded") or x.findtext("description") or x.findtext("content") or x.findtext("summary") or ""
        out.append({"id": (x.findtext("guid") or x.findtext("id") or link).strip(), "title": (x.findtext("title") or "").strip(), "url": link.strip(), "updated_at": (x.findtext("pubDate") or x.findtext("updated") or x.findtext("published") or "").strip(), "body": html_markdown(body, link)[1]})
    return out


# Headings of a code of law and its amendment marks.
_LAW = {
    "code": r"(?i)^#{1,6}\s*\[([a-zа-я0-9-]+)\]\s*(.*)$",
    "part": r"(?i)^(?:#{1,6}\s*Часть\s+([^\s.]+)[.:]?\s*(.*)|Часть\s+([^\s.]+)[.:]?\s*)$",
    "section": r"(?i)^(?:#{1,6}\s*Раздел\s+([0-9IVXLCDM]+)[.:]?\s*(.*)|Раздел\s+([0-9IVXLCDM]+)[.:]\s*(.*))$",
    "chapter": r"(?i)^(?:#{1,6}\s*Глава\s+([0-9IVXLCDM]+)[.:]?\s*(.*)|Глава\s+([0-9IVXLCDM]+)[.:]\s*(.*))$",
    "article": r"(?i)^(?:#{1,6}\s*Статья\s+([0-9]+(?:\.[0-9]+)*)[.:]?\s*(.*)|Статья\s+([0-9]+(?:\.[0-9]+)*)[.:]\s*(.*))$",
}
_AMENDED = r"(?i)в\s+(?:редакции|ред\.)\s+Федерального\s+закона\s+от\s+(\d{1,2})\.(\d{1,2})\.(\d{4})\s+(?:N|№)\s*([0-9]+(?:-[A-ZА-Я]+)*)"
_PLENUM = r"(?i)^#{1,6}\s*Постановление\s+Пленума\s+Верховного\s+Суда\s+РФ\s+от\s+(\d{1,2})\.(\d{1,2})\.(\d{4})\s+(?:N|№)\s*([0-9]+(?:-[A-ZА-Я]+)*)(?:\s+(.*))?$"
_POINT = r"(?i)^#{1,6}\s*Пункт\s+([0-9]+(?:\.[0-9]+)*)[.:]?\s*(.*)$"
_ORDINALS = {"первая": "1", "вторая": "2", "третья": "3", "четвертая": "4", "четвёртая": "4"}


def roman(x: str) -> str:
    """A Roman numeral as digits; digits stay."""
    worth = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    if not x or set(x.upper()) - set(worth):
        return x
    n = [worth[c] for c in x.upper()]
    return str(sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True)))


def law_articles(text: str) -> list[dict[str, str]]:
    """Articles and plenum points: id, kind, number, title, body, amendments as date:law in order, each once."""
    at = dict.fromkeys(("code", "part", "section", "chapter"), "")
    out: list[dict[str, str]] = []
    plenum, now = None, None
    for line in text.splitlines():
        s = line.strip()
        if m := re.match(_PLENUM, s):
            plenum, now = (f"{m[3]}-{int(m[2]):02d}-{int(m[1]):02d}", m[4]), None
        elif plenum and (m := re.match(_POINT, s)):
            now = {"id": f"plenum-{plenum[1]}-{plenum[0][:4]}/п{m[1]}", "kind": "legal-plenum-point", "number": m[1], "title": "", "body": m[2], "resolution_date": plenum[0], "resolution_number": plenum[1], "amendments": ""}
            out.append(now)
        elif level := next((k for k, p in _LAW.items() if re.match(p, s)), None):
            g = [x for x in re.match(_LAW[level], s).groups() if x is not None]
            number, title = g[0], g[1] if len(g) > 1 else ""
            if level == "article":
                parts = [at["code"], *(f"{p}{at[k]}" for k, p in (("part", "ч"), ("section", "р"), ("chapter", "гл")) if at[k]), f"ст{number}"]
                now = {"id": "/".join(p for p in parts if p), "kind": "legal-article", "number": number, "title": title, "body": "", "amendments": "", **at}
                out.append(now)
            else:
                keys = ("code", "part", "section", "chapter")
                for k in keys[keys.index(level) :]:
                    at[k] = ""
                at[level] = _ORDINALS.get(number.lower(), roman(number)) if level != "code" else number
                now = None
        elif now is not None:
            now["body"] += line + "\n"
    for x in out:
        marks = [f"{y}-{int(m):02d}-{int(d):02d}:{n}" for d, m, y, n in re.findall(_AMENDED, x["body"])]
        x["amendments"] = " ".join(dict.fromkeys(marks))
        x["body"] = x["body"].strip()
    return out
