"""Readers: files of a tree, corpora and question sets as document DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_segment, without_extension
from . import parse

DOCUMENT = "id string, source string, kind string, title string, url string, updated_at timestamp, body string, visibility string, summary string, frontmatter map<string,string>"
COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]


def _document(path: str, **fields: object) -> dict:
    return {"id": path, "source": None, "kind": "file", "title": None, "url": None, "updated_at": None, "body": "", "visibility": None, "summary": None, "frontmatter": {}} | fields


def _markdown(path: str, raw: bytes) -> list[dict]:
    known, rest, body = parse.frontmatter(raw.decode("utf-8", "replace"))
    first = next((x.lstrip("# ").strip() for x in body.splitlines() if x.startswith("#")), "")
    when = pd.Timestamp(known["updated_at"]).tz_convert(None) if known.get("updated_at") and pd.Timestamp(known["updated_at"]).tzinfo else pd.Timestamp(known["updated_at"]) if known.get("updated_at") else None
    return [_document(known.get("id") or path, source=known.get("source"), kind=known.get("kind") or "markdown", title=known.get("title") or first, url=known.get("url"), updated_at=when, body=body.strip(), visibility=known.get("visibility"), summary=known.get("summary"), frontmatter=rest)]


def _laws(path: str, raw: bytes) -> list[dict]:
    return [_document(x.pop("id"), kind=x.pop("kind"), title=x.pop("title"), body=x.pop("body"), frontmatter={k: v for k, v in x.items() if v}) for x in parse.law_articles(raw.decode("utf-8", "replace"))]


#: What each extension's files become. A reader of PDF text is injected, as there is none built in.
IMPORTERS: dict[str, Callable[[str, bytes], list[dict]]] = {
    ".md": _markdown,
    ".txt": lambda p, r: [_document(p, body=r.decode("utf-8", "replace").strip())],
    ".json": lambda p, r: [_document(p, kind="json", body=parse.flat_json(r.decode("utf-8-sig")))],
    ".xlsx": lambda p, r: [_document(f"{p}#{n}", kind="xlsx", title=n, body=b) for n, b in parse.xlsx_sheets(r)],
    ".sql": lambda p, r: [_document(f"{p}#{n}", kind="sql", title=n, body=b) for n, b in parse.ddl_tables(r.decode("utf-8", "replace"))],
    ".html": lambda p, r: [_document(p, kind="web", title=t, body=b) for t, b in [parse.html_markdown(r.decode("utf-8", "replace"), p)]],
    ".xml": lambda p, r: [_document(x["id"], kind="feed", title=x["title"], url=x["url"], body=x["body"]) for x in parse.feed_items(r.decode("utf-8", "replace"))],
    **{e: lambda p, r: [_document(p, kind="code", body=r.decode("utf-8", "replace"))] for e in (".go", ".py")},
}


def _imported(files: DataFrame, importers: dict[str, Callable[[str, bytes], list[dict]]]) -> DataFrame:
    """Documents and errors of (path, content) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                importer = importers.get("." + path.rpartition(".")[2].lower())
                if importer is None:
                    continue
                try:
                    rows = [d | {"error": None} for d in importer(path, bytes(raw))]
                except Exception as e:  # a file that cannot be read is a row of its own, not the end of the walk
                    rows = [_document(path) | {"error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame(rows).assign(path=path, updated_at=lambda d: pd.to_datetime(d["updated_at"]))[["path", *COLUMNS, "error"]]

    return files.mapInPandas(run, f"path string, {DOCUMENT}, error string")


def read_tree(spark: SparkSession, root: str, importers: dict | None = None, glob: str | None = None) -> DataFrame:
    """path, the document columns and error for each file under a root, by its extension; hidden folders are left out.

    Paths are relative to the root; the first folder is the source where a file names none.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (r.option("pathGlobFilter", glob) if glob else r).load(root).select("path", "content")
    rel = F.element_at(F.split("path", F.lit(root.rstrip("/").removeprefix("file://") + "/").cast("string")), -1)
    files = files.withColumn("path", rel).where(~F.col("path").rlike(r"(^|/)\."))
    out = _imported(files, importers or IMPORTERS)
    return out.withColumns({"source": F.coalesce("source", first_segment(F.col("path"))), "id": F.when(F.col("kind") == "markdown", F.col("id")).otherwise(F.col("id"))})


def law_tree(spark: SparkSession, root: str) -> DataFrame:
    """Articles and plenum points of the Markdown files under a root."""
    return read_tree(spark, root, {".md": _laws, ".txt": _laws})


def full_reconcile(documents: DataFrame) -> bool:
    """Whether what was read is all there is: only if no file failed."""
    return documents.where("error is not null").isEmpty()


def corpus_texts(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, source, title, body of `<source>/.../dsid_<id>__<slug>.txt`: the first line is the title. Sorted by path when written."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    rel = F.element_at(F.split("path", F.lit(root.rstrip("/") + "/").cast("string")), -1)
    name = F.regexp_extract("path", r"dsid_(.+?)__[^/]*\.txt$", 1)
    body = F.regexp_replace("value", "^\ufeff", "")
    return x.where(name != "").select(name.alias("doc_id"), first_segment(rel).alias("source"), F.trim(F.regexp_extract(body, r"^([^\r\n]*)", 1)).alias("title"), F.trim(F.regexp_replace(body, r"^[^\r\n]*\r?\n?", "")).alias("body"), rel.alias("path"))


def corpus_json(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, title, body, noise and warning of JSON documents that name their title and content fields."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["value"], strict=True):
                try:
                    d = json.loads(raw)
                    if not d.get("dataset_doc_uuid"):
                        raise ValueError("no dataset_doc_uuid")
                    text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
                    body = "\n\n".join(t for t in (text(d.get(k)) for k in d.get("content_field_names") or []) if t)
                    rows.append((d["dataset_doc_uuid"], text(d.get(d.get("title_field_name") or "")), body, bool(d.get("dataset_noise_document")), None, path))
                except (ValueError, AttributeError) as e:
                    rows.append((None, None, None, None, str(e), path))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "body", "noise", "warning", "path"])

    return x.mapInPandas(run, "doc_id string, title string, body string, noise boolean, warning string, path string")


QUESTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("question_id", "question_type")]
    + [T.StructField("source_types", T.ArrayType(T.StringType())), T.StructField("question", T.StringType()), T.StructField("expected_doc_ids", T.ArrayType(T.StringType()))]
    + [T.StructField("gold_answer", T.StringType()), T.StructField("answer_facts", T.ArrayType(T.StringType())), T.StructField("language", T.StringType()), T.StructField("_corrupt", T.StringType())]
)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; a malformed line has its text in _corrupt, blank lines and a mark in front go."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("v")).where(F.trim("v") != "")
    q = F.from_json("v", QUESTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(q.alias("q")).select("q.*")


def doc_ref_id(path: Column) -> Column:
    return without_extension(path)


def pages_markdown(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with title and body: the page as Markdown."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [parse.html_markdown(h or "", u or "") for u, h in zip(f[url], f[html], strict=True)]
            yield f.drop(columns=[html]).assign(title=[g[0] for g in got], body=[g[1] for g in got])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html]
    return pages.mapInPandas(run, ", ".join([*fields, "title string", "body string"]))


def html_text(html: Column) -> Column:
    """A page's plain text by rule, in built-in functions: no scripts and styles, no tags, single spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
