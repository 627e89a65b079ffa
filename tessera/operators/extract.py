"""From chunks to entities and relations: by a model, from chats, from legal texts, from code."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import amendments, chat_time, entity_id, fallback_summary, is_small_talk, normal_name, relation_id, strip_code_fence
from ..models import Chat, asked

EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string,valid_from:string,valid_to:string>>"
CHAT_EDGES = ("DECIDED", "PROPOSED", "AGREED")


def parsed(reply: Column) -> Column:
    """A model's extraction JSON as a struct; a reply that is none has nulls."""
    return F.from_json(strip_code_fence(reply), EXTRACTION)


def extracted(chunks: DataFrame, chat: Chat, gleaning: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that a model finds in chunks (id, text): a row each, with the chunk it came from.

    With gleaning a second call asks for what the first left out. A chunk whose reply cannot be read
    gives nothing.
    """
    x = asked(chunks.where(F.trim("text") != "").select("id", F.col("text").alias("prompt")), chat, "Extract entities and relations as JSON.")
    rows = x.select("id", parsed(F.col("reply")).alias("x"))
    if gleaning:
        again = asked(x.where(F.col("reply").isNotNull()).select("id", F.concat_ws("\n\n", "prompt", "reply").alias("prompt")), chat, "Name what was left out, as the same JSON.")
        rows = rows.unionByName(again.select("id", parsed(F.col("reply")).alias("x")))
    ents = rows.select(F.col("id").alias("chunk"), F.explode("x.entities").alias("e")).select("chunk", "e.*").where(F.trim("name") != "")
    rels = rows.select(F.col("id").alias("chunk"), F.explode("x.relations").alias("r")).select("chunk", "r.*")
    return ents.withColumn("id", entity_id(F.col("name"), F.coalesce("type", F.lit("")))), rels


def chat_relations(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """Decision edges of chats (chunk, source, target, type, valid_from) with the speaker who made them.

    chunks: id, text, speakers array<string>, ts, speaker_ts map<string,string>. relations: chunk, source,
    target, type. Small talk has none. With several speakers a source that is none of them is the first;
    with one it is that one. The time is the speaker's, else the chunk's.
    """
    c = chunks.where(~is_small_talk(F.col("text"))).select(F.col("id").alias("chunk"), "speakers", "ts", "speaker_ts")
    x = relations.withColumn("type", F.upper(F.trim("type"))).where(F.col("type").isin(*CHAT_EDGES)).join(c, "chunk").where(F.size("speakers") > 0)
    named = F.exists("speakers", lambda s: normal_name(s) == normal_name(F.col("source")))
    source = F.when((F.size("speakers") > 1) & named, F.trim("source")).otherwise(F.get("speakers", F.lit(0)))
    x = x.withColumn("source", source).where(normal_name(F.col("source")) != normal_name(F.col("target")))
    when = F.coalesce(chat_time(F.try_element_at("speaker_ts", normal_name(F.col("source")))), chat_time(F.col("ts")))
    return x.select("chunk", "source", "target", "type", when.alias("valid_from"))


def legal_article(metadata: Column) -> Column:
    """The id of a legal article from its frontmatter, or null."""
    m = lambda k: F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    part = lambda mark, k: F.when(m(k) != "", F.concat(F.lit(mark), m(k)))
    built = F.concat_ws("/", m("code"), part("ч", "part"), part("р", "section"), part("гл", "chapter"), F.concat(F.lit("ст"), m("article_number")))
    return F.when(m("id") != "", m("id")).when((m("code") != "") & (m("article_number") != ""), built)


def legal_graph(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of legal articles with amendments; articles has metadata.

    An amendment law is an entity, and its edge to the article holds from its date to the next one's.
    """
    m = F.col("metadata")
    title = F.coalesce(F.try_element_at(m, F.lit("article_title")), F.lit(""))
    name = F.concat(F.lit("Статья "), F.coalesce(F.try_element_at(m, F.lit("article_number")), F.lit("")), F.when(title != "", F.concat(F.lit(". "), title)).otherwise(""))
    x = articles.withColumn("article", legal_article(m)).where("article is not null")
    x = x.select("article", name.alias("name"), entity_id(F.col("article"), F.lit("legal-article")).alias("dst"), F.posexplode(amendments(F.coalesce(F.try_element_at(m, F.lit("redactions")), F.lit("")))).alias("pos", "a"))
    x = x.select("article", "name", "dst", "pos", F.col("a.date").alias("date"), F.col("a.law").alias("law"))
    # The next in order of date, so that of two on one day the first ends at once.
    x = x.withColumn("valid_to", F.lead("date").over(Window.partitionBy("article").orderBy("date", "pos")))
    action = F.concat(F.lit("Федеральный закон от "), F.date_format("date", "dd.MM.yyyy"), F.lit(" N "), F.col("law"))
    x = x.withColumn("action", action).withColumn("src", entity_id(F.col("action"), F.lit("legal-amendment")))
    ents = x.select(F.col("dst").alias("id"), "name", F.lit("legal-article").alias("type"), F.concat(F.lit("Статья кодекса "), "article").alias("description"))
    laws = x.select(F.col("src").alias("id"), F.col("action").alias("name"), F.lit("legal-amendment").alias("type"), F.concat(F.lit("Поправка к "), "article").alias("description"))
    rels = x.select(relation_id(F.col("src"), F.col("dst"), F.lit("amends")).alias("id"), "src", "dst", F.lit("amends").alias("type"), F.lit(1.0).alias("weight"), F.col("date").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"))
    return ents.union(laws).dropDuplicates(["id"]), rels


def retarget(relations: DataFrame, articles: DataFrame, number: Column) -> DataFrame:
    """relations with dst moved to the article of that number where exactly one has it; articles: id, number."""
    only = articles.groupBy("number").agg(F.count("*").alias("n"), F.min("id").alias("canonical")).where("n = 1").select("number", "canonical")
    x = relations.withColumn("number", number).join(only, "number", "left")
    return x.withColumn("dst", F.coalesce("canonical", "dst")).drop("number", "canonical")


def resolve_statutes(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """cited (chunk_id, file) with article: by chunk, else by file where the file has one article only."""
    chunk = corpus.select("chunk_id", F.col("article").alias("by_chunk")).dropDuplicates(["chunk_id"])
    one = corpus.groupBy("file").agg(F.countDistinct("article").alias("n"), F.min("article").alias("by_file")).where("n = 1").drop("n")
    return cited.join(chunk, "chunk_id", "left").join(one, "file", "left").withColumn("article", F.coalesce("by_chunk", "by_file")).drop("by_chunk", "by_file")


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of Python sources (path, text): modules, classes, functions, methods.

    Relations: DECLARES, IMPORTS, CALLS (to names declared in the same file), IMPLEMENTS (base classes).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [r for path, text in zip(f["path"], f["text"], strict=True) for r in _python_symbols(path, text or "")]
            yield pd.DataFrame(out, columns=["what", "a", "b", "kind", "path"])

    x = files.select("path", "text").mapInPandas(run, "what string, a string, b string, kind string, path string")
    ents = x.where("what = 'entity'").select(F.col("a").alias("name"), F.col("kind").alias("type"), "path", entity_id(F.col("a"), F.col("kind")).alias("id"))
    return ents, x.where("what = 'relation'").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("kind").alias("type"), "path")


def _python_symbols(path: str, text: str) -> list[tuple]:
    module = path.removesuffix(".py").replace("/", ".")
    out = [("entity", module, None, "package", path)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out
    known = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}

    def visit(node: ast.AST, owner: str, inside: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import | ast.ImportFrom):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or "."]
                out.extend(("relation", module, x, "IMPORTS", path) for x in names)
            elif isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                cls = isinstance(n, ast.ClassDef)
                name = f"{owner}.{n.name}" if inside else n.name
                out.append(("entity", name, None, "type" if cls else "method" if inside else "function", path))
                out.append(("relation", owner if inside else module, name, "DECLARES", path))
                if cls:
                    out.extend(("relation", name, b.id, "IMPLEMENTS", path) for b in n.bases if isinstance(b, ast.Name))
                    visit(n, name, True)
                else:
                    calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
                    out.extend(("relation", name, c, "CALLS", path) for c in sorted(calls & known))

    visit(tree, module, False)
    return out


def community_titles(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(community, title): the first three member names in order; members: community, id."""
    x = members.join(entities.select("id", "name"), "id")
    first = Window.partitionBy("community").orderBy("name", "id")
    x = x.withColumn("nth", F.row_number().over(first)).where("nth <= 3")
    return x.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda s: s["name"]), ", ").alias("title"))


def described(docs: DataFrame, chat: Chat | None = None) -> DataFrame:
    """docs (id, body, summary) with a summary for those without: a model's, else the first sentence."""
    x = docs.where("summary is null or trim(summary) = ''")
    rest = docs.where("not (summary is null or trim(summary) = '')")
    if chat is None:
        return rest.unionByName(x.withColumn("summary", fallback_summary(F.col("body"))))
    got = asked(x.withColumn("prompt", F.col("body")), chat, "Describe the document in one sentence.")
    return rest.unionByName(got.withColumn("summary", F.coalesce(F.when(F.trim("reply") != "", F.trim("reply")), fallback_summary(F.col("body")))).select(docs.columns))
