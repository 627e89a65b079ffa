"""Evaluation: score reports, recall, currency, graph differences, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_citation, trim_space

ABSTAIN = "does not contain the information needed to answer"


def is_abstain(answer: Column, sentinel: str) -> Column:
    return (answer == sentinel) | answer.contains(ABSTAIN)


def score_report(scored: DataFrame) -> DataFrame:
    """(type, n, hits, answers, facts): a row a type and one over all, weighted by question.

    scored: type, hit, answer (booleans), facts (share or null).
    """
    n = F.count("*").alias("n")
    hits, answers = F.count_if("hit").alias("hits"), F.count_if("answer").alias("answers")
    return scored.rollup("type").agg(n, hits, answers, F.avg("facts").alias("facts"), F.grouping("type").alias("g")).select(F.when(F.col("g") == 1, "*").otherwise(F.col("type")).alias("type"), "n", "hits", "answers", "facts")


def run_report(answers: DataFrame) -> DataFrame:
    """(type, language, n, abstain, cited, recall) by type, by language and over all, in one pass.

    answers: type, language, abstain, cited (booleans), recall.
    """
    sets = answers.groupingSets([["type"], ["language"], []], "type", "language")
    return sets.agg(F.count("*").alias("n"), F.count_if("abstain").alias("abstain"), F.count_if("cited").alias("cited"), F.avg("recall").alias("recall"), F.grouping_id().alias("level"))


def flags(answers: DataFrame, sentinel: str = "") -> DataFrame:
    a = F.col("answer")
    return answers.withColumns({"abstain": is_abstain(a, sentinel), "cited": has_citation(a)})


def compare_reports(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, <v>_before, <v>_after, <v>_delta); what a side lacks counts 0."""
    x = before.select(key, *(F.col(v).alias(f"{v}_before") for v in values)).join(after.select(key, *(F.col(v).alias(f"{v}_after") for v in values)), key, "full_outer")
    x = x.na.fill(0, [f"{v}_{s}" for v in values for s in ("before", "after")])
    return x.withColumns({f"{v}_delta": F.col(f"{v}_after") - F.col(f"{v}_before") for v in values})


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int, distinct: bool = True) -> DataFrame:
    """(query_id, recall): relevant documents among the first k hits, over all relevant ones.

    hits: query_id, rank, doc. distinct=False counts chunks, so two chunks of one document count twice.
    A query without relevant documents has recall 1.
    """
    rel = relevant.select("query_id", "doc").distinct()
    found = hits.where(F.col("rank") <= k).join(rel, ["query_id", "doc"], "left_semi")
    found = found.groupBy("query_id").agg((F.countDistinct("doc") if distinct else F.count("*")).alias("found"))
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    every = hits.select("query_id").union(rel.select("query_id")).distinct()
    x = every.join(total, "query_id", "left").join(found, "query_id", "left")
    return x.select("query_id", F.when(F.col("total").isNull(), 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"))


def dcs_report(states: DataFrame) -> DataFrame:
    """One row: rates of the four states, adoption, stability and their harmonic mean.

    states: control, before, after (states as texts).
    """
    a = states.agg(
        F.count_if(~F.col("control")).alias("affected"), F.count_if("control").alias("control"),
        *[F.count_if(~F.col("control") & (F.col("after") == s)).alias(s) for s in ("current", "stale", "hedged", "missing")],
        F.count_if(~F.col("control") & (F.col("before") == "stale")).alias("eligible"),
        F.count_if(~F.col("control") & (F.col("before") == "stale") & (F.col("after") == "current")).alias("flipped"),
        F.count_if(F.col("control") & (F.col("before") == "current") & (F.col("after") == "current")).alias("stable"),
    )
    rate = lambda n, d: F.when(F.col(d) == 0, 0.0).otherwise(F.col(n) / F.col(d))
    x = a.select("affected", "control", "eligible", rate("current", "affected").alias("currency"), rate("stale", "affected").alias("stale_leak"), rate("hedged", "affected").alias("hedge"), rate("missing", "affected").alias("miss"), rate("flipped", "eligible").alias("adoption"), rate("stable", "control").alias("stability"))
    adopt = F.when(F.col("eligible") == 0, F.col("currency")).otherwise(F.col("adoption"))
    both = F.when(adopt + F.col("stability") == 0, 0.0).otherwise(2 * adopt * F.col("stability") / (adopt + F.col("stability")))
    return x.withColumn("dcs", F.when(F.col("control") == 0, F.col("currency")).when(F.col("affected") == 0, F.col("stability")).otherwise(both))


def actualization(rows: DataFrame) -> DataFrame:
    """One row of counts over answers before and after; rows: affected, before_ok, after_ok, changed."""
    a, b, ok, ch = (F.col(c) for c in ("affected", "before_ok", "after_ok", "changed"))
    return rows.agg(
        F.count_if(a).alias("affected"), F.count_if(~a).alias("control"), F.count_if(a & b & ok).alias("updated"), F.count_if(a & ~ok).alias("not_updated"),
        F.count_if(~a & ok & ~ch).alias("stable"), F.count_if(~a & ~ok).alias("regressed"),
    )


def hit_rates(results: DataFrame) -> DataFrame:
    """(source, passed, total, rate): each result counts once for each of its distinct sources."""
    x = results.select(F.explode(F.array_distinct("sources")).alias("source"), "passed")
    return x.groupBy("source").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn("rate", F.col("passed") / F.col("total"))


def graph_diff(expected: DataFrame, actual: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """(id, kind, field): rows missing or extra, and each field that differs, nulls being equal to nulls."""
    e, a = expected.alias("e"), actual.alias("a")
    x = e.join(a, F.col(f"e.{key}") == F.col(f"a.{key}"), "full_outer")
    kind = F.when(F.col(f"a.{key}").isNull(), F.array(F.struct(F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("field"))))
    kind = kind.when(F.col(f"e.{key}").isNull(), F.array(F.struct(F.lit("extra").alias("kind"), F.lit(None).cast("string").alias("field"))))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.struct(F.lit("differs").alias("kind"), F.lit(f).alias("field"))) for f in fields]))
    return x.select(F.coalesce(f"e.{key}", f"a.{key}").alias(key), F.explode(kind.otherwise(differ)).alias("d")).select(key, "d.kind", "d.field")


def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, raw, found): what an answer cites in brackets, held against its context.

    answers: answer_id, answer. context: answer_id, chunk_id, file_name, file_path. A bracket that names
    nothing as a whole is tried by its parts between commas and white space.
    """
    quote = r"^[\"'“”]+|[\"'“”]+$"
    clean = lambda c: F.regexp_replace(trim_space(c), quote, "")
    x = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"[\[(]([^\[\]()]+)[\])]"), F.lit(1))).alias("pos", "raw"))
    x = x.withColumn("raw", clean(F.col("raw"))).where("raw <> ''")
    names = context.select("answer_id", F.explode(F.array("chunk_id", "file_name", "file_path")).alias("raw")).where("raw is not null and raw <> ''").distinct()
    known = names.withColumn("found", F.lit(True))
    whole = x.join(known, ["answer_id", "raw"], "left")
    ok = whole.where("found").select("answer_id", "pos", "raw", "found")
    rest = whole.where("found is null").withColumn("parts", F.filter(F.split("raw", r"[,\s]+"), lambda p: p != ""))
    parts = rest.select("answer_id", "pos", F.explode("parts").alias("raw")).withColumn("raw", F.regexp_replace("raw", quote, "")).join(known, ["answer_id", "raw"], "left")
    return ok.union(parts.select("answer_id", "pos", "raw", F.coalesce("found", F.lit(False)))).select("answer_id", "raw", "found")


def translate_ids(rows: DataFrame, mapping: DataFrame, key: str = "id", ids: str = "ids") -> DataFrame:
    """rows with ids translated (public, private) in order; unmapped ones go."""
    x = rows.select(key, F.posexplode(ids).alias("pos", "public")).join(mapping, "public")
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "private"))), lambda s: s["private"]).alias(ids))


def gold_subset(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """Questions all of whose expected documents are kept (doc); those without any are not."""
    x = questions.select("question_id", F.explode("expected_doc_ids").alias("doc"))
    missing = x.join(kept.select("doc"), "doc", "left_anti").select("question_id").distinct()
    return questions.where(F.size("expected_doc_ids") > 0).join(missing, "question_id", "left_anti")


def limit_per_type(questions: DataFrame, n: int) -> DataFrame:
    """The first n questions of each type in the order of position."""
    return questions.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy("position"))).where(F.col("nth") <= n).drop("nth")


def submission_scores(gold: DataFrame, submission: DataFrame) -> DataFrame:
    """gold left-joined with its submission; matched tells whether there is one."""
    return gold.join(submission.withColumn("matched", F.lit(True)), "question_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def superseded_pairs(rows: DataFrame) -> DataFrame:
    """(old, new): a result whose superseding document is in the result too, with that document's first chunk."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("ref_doc_id").orderBy("rank"))).where("nth = 1").select(F.col("id").alias("new"), F.col("ref_doc_id").alias("doc"))
    return rows.join(first, rows.superseded_by == first.doc).select(F.col("id").alias("old"), "new")


def deterministic_coverage(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, coverage): half how many of k chunks there are, half their mean score, both at most 1."""
    n = F.least(F.count("*") / max(k, 1), F.lit(1.0))
    mean = F.greatest(F.least(F.avg("score"), F.lit(1.0)), F.lit(0.0))
    return rows.groupBy(key).agg(((n + mean) / 2).alias("coverage"))


def legal_as_of(redactions: DataFrame) -> DataFrame:
    """One row: the corpus's date, that of its latest redaction (article, date)."""
    return redactions.agg(F.max("date").alias("as_of"))


def legal_report(cited: DataFrame, articles: DataFrame, plenums: DataFrame, relevant: DataFrame, claims: DataFrame) -> DataFrame:
    """(metric, passed, total, rate) of the three legal metrics, in one row each.

    cited: question_id, position, article (null where the citation resolves to nothing). articles: article,
    current (in force at the date asked for). plenums: article, known rulings, which do not count.
    relevant: question_id, article, passed; claims: question_id, passed; both hold what the judge decided,
    so its failures are absent. An article counts once a question for nhsr, and each citation of nothing
    known counts against it.
    """
    x = cited.join(articles.select("article", "current").dropDuplicates(["article"]), "article", "left").join(plenums.select("article", F.lit(True).alias("plenum")).distinct(), "article", "left")
    known = x.where("current is not null").select("question_id", "article", "current").distinct()
    unknown = x.where("current is null and plenum is null").agg(F.lit(0).cast("long").alias("passed"), F.count("*").alias("total"))
    nhsr = known.agg(F.count_if("current").alias("passed"), F.count("*").alias("total")).unionByName(unknown).agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    srr = relevant.join(known.select("question_id", "article"), ["question_id", "article"], "left_semi").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    lct = claims.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    out = nhsr.select(F.lit("nhsr").alias("metric"), "passed", "total").union(srr.select(F.lit("srr"), "passed", "total")).union(lct.select(F.lit("lct"), "passed", "total"))
    return out.withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("passed") / F.col("total")))


def golden_set(documents: DataFrame, source: str = "") -> DataFrame:
    """(id, source, question, expected): closed issues of one source, or of all, with a title and a body.

    documents: id, source, kind, title, body, frontmatter.
    """
    x = documents.where((F.col("kind") == "issue") & (F.element_at("frontmatter", "state") == "closed"))
    if source:
        x = x.where(F.col("source") == source)
    x = x.select("id", "source", trim_space(F.col("title")).alias("question"), trim_space(F.col("body")).alias("expected"))
    return x.where("question <> '' and expected <> ''")


def with_affordable(stages: DataFrame, budget: float, seconds: str = "seconds", pool: str = "pool") -> DataFrame:
    """stages with column affordable: as many of a stage's items as the budget, in seconds, pays for.

    A stage names the seconds of an item and the items there are (null: no bound). Null, negative or zero
    seconds or budgets afford none.
    """
    paid = F.floor(F.lit(budget) / F.nullif(F.greatest(F.col(seconds), F.lit(0.0)), F.lit(0.0))).cast("long")
    return stages.withColumn("affordable", F.greatest(F.coalesce(F.when(paid.isNotNull(), F.least(paid, F.col(pool))), F.lit(0)), F.lit(0)))


#: Fixed values, rungs of the evolution ladder: the answer mode, and what each switches on beyond the rung before it.
LADDER = (
    ("native", "naive", ()),
    ("hybrid", "naive", ("hybrid",)),
    ("graph", "naive", ("graph",)),
    ("rerank", "naive", ("rerank",)),
    ("logic", "got", ()),
    ("temporal", "got", ("strict_supersede", "contradictions")),
    ("qualifiers", "got", ("qualifier_filter",)),
)


def ladder() -> list[tuple[str, str, frozenset[str]]]:
    """(rung, answer mode, all that is on) from the plainest to the fullest; what a rung switches on stays on."""
    on: frozenset[str] = frozenset()
    return [(name, mode, on := on | set(new)) for name, mode, new in LADDER]
