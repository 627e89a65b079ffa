"""Judges and generators over an injected chat model: contradictions, answers, statutes, claims, questions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fence, trim_space
from ..models import Chat, asked

SUB_QUERIES = 5


def unfenced(text: str) -> str:
    """A reply without the code fence around it."""
    t = text.strip()
    if t.startswith("```"):
        t = t.removeprefix("```").removeprefix("json").removesuffix("```").strip()
    return t


def expanded(query: str, chat: Chat | None) -> list[str]:
    """One to SUB_QUERIES sub-queries of a query; the query itself where the model is absent, fails or gives none.

    A reply is a JSON list, or an object with the list as subqueries.
    """
    if chat is None or not query.strip():
        return [query]
    try:
        got = json.loads(unfenced(chat.chat("Give three to five sub-queries that cover the question, as a JSON list.", query)))
        got = got.get("subqueries") if isinstance(got, dict) else got
        # A list with anything but texts in it is no answer.
        texts = [q.strip() for q in got if q.strip()] if isinstance(got, list) else []
    except Exception:
        texts = []
    return texts[:SUB_QUERIES] or [query]


def contradictions(rows: DataFrame, chat: Chat) -> DataFrame:
    """(query_id, chunk_a, chunk_b, reason, failed) of what each question's excerpts contradict each other in.

    rows: query_id, query, rank, chunk_id, file_name, text, the retrieved chunks of each question. A
    question with fewer than two excerpts is not asked about. A reply that is no JSON list gives one row
    with failed; a pair without both names goes.
    """
    label = F.coalesce(F.nullif("chunk_id", F.lit("")), "file_name", F.lit(""))
    line = F.concat(F.lit("- ["), label, F.lit("] "), F.coalesce("text", F.lit("")))
    x = rows.groupBy("query_id").agg(F.max("query").alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    head = F.when(F.coalesce(trim_space(F.col("query")), F.lit("")) != "", F.concat(F.lit("Question: "), "query", F.lit("\n\n"))).otherwise("")
    prompts = x.where(F.size("lines") >= 2).select("query_id", F.concat(head, F.lit("Excerpts:\n"), F.array_join("lines", "\n")).alias("prompt"))
    replies = asked(prompts, chat, "Name the excerpts that contradict each other as a JSON list of {chunk_a, chunk_b, reason}.")
    got = F.from_json(strip_code_fence(F.col("reply")), "array<struct<chunk_a string, chunk_b string, reason string>>")
    found = replies.select("query_id", F.explode_outer(F.coalesce(got, F.array(F.lit(None).cast("struct<chunk_a string, chunk_b string, reason string>")))).alias("c"), got.isNull().alias("failed"))
    clean = lambda f: F.coalesce(trim_space(F.col(f"c.{f}")), F.lit("")).alias(f)
    return found.where("failed or c is not null").select("query_id", clean("chunk_a"), clean("chunk_b"), clean("reason"), "failed").where("failed or chunk_a <> '' or chunk_b <> ''")


def verdicts(rows: DataFrame, chat: Chat, system: str) -> DataFrame:
    """rows (prompt, ...) with passed and reason from replies like {"passed": true, "reason": "..."}; null where the judge failed.

    The judge of answers, of a statute's relevance, of a claim's truth and of faithfulness differ in what the
    prompt holds and what the system text asks.
    """
    v = F.from_json(strip_code_fence(F.col("reply")), "passed boolean, reason string")
    return asked(rows, chat, system).withColumn("v", v).select(*rows.columns, F.col("v.passed").alias("passed"), F.col("v.reason").alias("reason"))


def qa_prompt() -> Column:
    """The prompt of the answers' judge from question, expected and answer."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", part("Question", "question"), part("Expected", "expected"), part("Answer", "answer"))


def generated_questions(chunks: DataFrame, chat: Chat) -> DataFrame:
    """(id, question, answer) that the model makes of each chunk (id, text), if the text holds the answer word by word.

    Case and runs of white space do not count. A reply that is no JSON object with both goes.
    """
    prompts = chunks.select("id", "text", F.col("text").alias("prompt"))
    q = F.from_json(strip_code_fence(F.col("reply")), "question string, answer string")
    x = asked(prompts, chat, "Write one question that the text answers, as JSON {question, answer}; quote the answer.").select("id", "text", trim_space(q["question"]).alias("question"), trim_space(q["answer"]).alias("answer"))
    plain = lambda c: F.lower(F.regexp_replace(trim_space(F.col(c)), r"\s+", " "))
    return x.where("question <> '' and answer <> ''").where(F.contains(plain("text"), plain("answer"))).select("id", "question", "answer")
