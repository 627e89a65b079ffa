"""Chat and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions.text import SMALL_TALK, estimate_tokens, tokens
from ..operators import chunking as C
from ..operators import evaluate as E
from ..operators import lexical as L
from .adapters import CHUNKS, bm25_sql, chunks
from .registry import Registry, table

R = Registry()
_TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


@R.query("with g as (select *, coalesce(ts > lag(ts) over w + interval 24 hours, false) as late from events window w as (partition by user_id order by ts, event_id)) select event_id, cast(sum(late::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as session from g")
def chat_sessions(spark: SparkSession, at: str) -> DataFrame:
    return C.sessions(table(spark, at, "events"), ["user_id"], order=["event_id"]).select("event_id", "session")


def _messages(spark: SparkSession, at: str) -> DataFrame:
    c = table(spark, at, "conversations")
    return c.select("conv_id", F.col("turn").alias("order"), F.col("role").alias("user"), "text", F.col("turn").alias("ts"))


@R.query("with m as (select conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, text, count(distinct role) over (partition by conv_id) as n from conversations), g as (select conv_id, min(turn) as first, string_agg(case when n > 1 then role || ': ' || t else text end, e'\\n\\n' order by turn, role, t) as text, case when max(n) > 1 then array_to_string(list_sort(list_distinct(list(role))), ',') end as speakers from m where t <> '' group by conv_id) select conv_id, first, md5(text) as text, greatest(1, length(text) // 4) as token_count, speakers from g")
def thread_glue(spark: SparkSession, at: str) -> DataFrame:
    x = C.glued_threads(_messages(spark, at), ["conv_id"])
    return x.select("conv_id", "first", F.md5("text").alias("text"), "token_count", F.array_join("speakers", ",").alias("speakers"))


@R.query("with s as (select conv_id, role as user, min(turn) as ts from conversations group by all) select * from s qualify count(*) over (partition by conv_id) > 1")
def speaker_first_ts(spark: SparkSession, at: str) -> DataFrame:
    return C.speakers(_messages(spark, at), ["conv_id"])


_SMALL = ", ".join(f"'{w}'" for w in SMALL_TALK)


@R.query(f"with m as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations) select conv_id, turn from m where not (regexp_full_match(t, '[\\p{{P}}\\p{{S}}\\p{{Z}}]*') or lower(t) in ({_SMALL}) or length(t) < 20)")
def small_talk_filter(spark: SparkSession, at: str) -> DataFrame:
    return C.meaningful(table(spark, at, "conversations")).select("conv_id", "turn")


@R.query("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as n from events")
def rate_limit_sliding(spark: SparkSession, at: str) -> DataFrame:
    return C.sliding_counts(table(spark, at, "events"), "user_id", "ts", 6 * 3600).select("event_id", "n")


@R.query()
def sentence_chunks(spark: SparkSession, at: str) -> DataFrame:
    """Sentence packing is a fold over a document; it is tested against a loop."""
    return C.text_chunks(table(spark, at, "documents"), "doc_id", "text", 128, 16)


def _answers(spark: SparkSession, at: str) -> DataFrame:
    """Documents as answers: the language is the type, quality the hit, toxic the answer."""
    d = table(spark, at, "documents").join(table(spark, at, "labels"), "doc_id")
    return d.select("doc_id", F.col("lang").alias("type"), F.col("source").alias("language"), (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("answer"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 10) / 10).alias("facts"), "text")


_ANS = "ans as (select d.doc_id, lang as type, source as language, quality = 1 as hit, toxic = 1 as answer, case when d.doc_id % 3 = 0 then (d.doc_id % 10) / 10 end as facts, text from documents d join labels l on d.doc_id = l.doc_id)"


@R.query(f"with {_ANS} select case when grouping(type) = 1 then '*' else type end as type, count(*) as n, count(*) filter (hit) as hits, count(*) filter (answer) as answers, round(avg(facts), 6) as facts from ans group by rollup (type)")
def score_by_type(spark: SparkSession, at: str) -> DataFrame:
    return E.score_report(_answers(spark, at)).withColumn("facts", F.round("facts", 6))


@R.query(f"with {_ANS} select type, language, count(*) as n, count(*) filter (hit) as abstain, count(*) filter (answer) as cited, round(avg(facts), 6) as recall from ans group by grouping sets ((type), (language), ())")
def run_report_grouping_sets(spark: SparkSession, at: str) -> DataFrame:
    x = _answers(spark, at).select("type", "language", F.col("hit").alias("abstain"), F.col("answer").alias("cited"), F.col("facts").alias("recall"))
    return E.run_report(x).withColumn("recall", F.round("recall", 6)).drop("level")


@R.query(f"with {_ANS}, b as (select language, count(*) as n from ans where hit group by 1), a as (select language, count(*) as n from ans where answer group by 1) select language, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after, coalesce(a.n, 0) - coalesce(b.n, 0) as n_delta from b full join a using (language)")
def report_compare(spark: SparkSession, at: str) -> DataFrame:
    x = _answers(spark, at)
    return E.compare_reports(x.where("hit").groupBy("language").agg(F.count("*").alias("n")), x.where("answer").groupBy("language").agg(F.count("*").alias("n")), "language", ["n"])


def _pairs(spark: SparkSession, at: str) -> DataFrame:
    """Every document with one benchmark item, dealt by its number."""
    items = table(spark, at, "benchmark")
    n = items.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    b = items.select("item_id", F.col("text").alias("fact"), F.row_number().over(Window.orderBy("item_id")).cast("long").alias("nth"))
    d = table(spark, at, "documents").select("doc_id", F.col("text").alias("answer"))
    # One row that holds the number of items.
    d = d.crossJoin(F.broadcast(n)).withColumn("nth", F.col("doc_id") % F.col("n") + 1)
    return d.join(b, "nth").select("item_id", "doc_id", "fact", "answer")


_PAIRS = "items as (select item_id, text, row_number() over (order by item_id) - 1 as nth from benchmark), pairs as (select item_id, doc_id, b.text as fact, d.text as answer from documents d join items b on d.doc_id % (select count(*) from benchmark) = b.nth)"


@R.query(f"with {_PAIRS}, t as (select item_id, doc_id, {_TOK.format(x='answer')} as w, {_TOK.format(x='fact')}[1:3] as p from pairs) select item_id, doc_id, len(list_filter(range(1, greatest(len(w) - len(p) + 2, 1)), lambda i: w[i:i + len(p) - 1] = p)) > 0 as found from t")
def phrase_match(spark: SparkSession, at: str) -> DataFrame:
    x = _pairs(spark, at)
    return x.select("item_id", "doc_id", P.phrase_at(tokens(F.col("answer")), F.slice(tokens(F.col("fact")), 1, 3)).alias("found"))


_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS["en"])
_NEG = ", ".join(f"'{w}'" for w in P.NEGATIONS["en"])


def _content(x: str) -> str:
    parted = f"regexp_replace({x}, '([0-9])([A-Za-z])|([A-Za-z])([0-9])', '\\1\\3 \\2\\4', 'g')"
    return f"list_filter({_TOK.format(x=parted)}, lambda t: (length(t) > 1 or regexp_full_match(t, '[0-9]+')) and t not in ({_STOP}))"


@R.query(f"""with {_PAIRS}, c as (select item_id, doc_id, {_content('answer')} as a, {_content('fact')} as f, len(list_filter({_TOK.format(x='answer')}, lambda t: t in ({_NEG}))) % 2 as na, len(list_filter({_TOK.format(x='fact')}, lambda t: t in ({_NEG}))) % 2 as nf from pairs),
s as (select *, case when len(a) > 0 and len(f) > 0 then len(list_filter(f, lambda t: list_contains(a, t))) / len(f) else 0 end as share from c)
select item_id, doc_id, round(share, 6) as share, na = nf and share >= 0.8 as covered from s""")
def fact_coverage(spark: SparkSession, at: str) -> DataFrame:
    a, f = F.col("answer"), F.col("fact")
    return _pairs(spark, at).select("item_id", "doc_id", F.round(P.share_present(P.content_words(a), P.content_words(f)), 6).alias("share"), P.fact_covered(a, f).alias("covered"))


@R.query(f"with {_PAIRS}, t as (select item_id, doc_id, list_distinct({_TOK.format(x='answer')}) as a, list_distinct({_TOK.format(x='fact')}) as f from pairs) select item_id, doc_id, round(len(list_intersect(a, f)) / len(list_distinct(list_concat(a, f))), 6) as overlap from t")
def jaccard_overlap(spark: SparkSession, at: str) -> DataFrame:
    return _pairs(spark, at).select("item_id", "doc_id", F.round(P.jaccard(tokens(F.col("answer")), tokens(F.col("fact"))), 6).alias("overlap"))


@R.query(f"with {_PAIRS}, t as (select item_id, doc_id, list_distinct({_content('answer')}) as a, list_distinct({_content('fact')}) as f from pairs) select item_id, doc_id, round(case when len(a) = 0 then 0 else len(list_intersect(a, f)) / len(a) end, 6) as precision, round(case when len(f) = 0 then 0 else len(list_intersect(a, f)) / len(f) end, 6) as recall from t")
def context_precision_recall(spark: SparkSession, at: str) -> DataFrame:
    # Each text's words and what both share are found once a row: a later step that used the expressions would find them anew.
    x = _pairs(spark, at).select("item_id", "doc_id", *[F.array_distinct(P.content_words(F.col(c))).alias(c) for c in ("answer", "fact")])
    x = x.select("item_id", "doc_id", F.size("answer").alias("a"), F.size("fact").alias("f"), F.size(F.array_intersect("answer", "fact")).alias("both"))
    share = lambda n: F.round(F.when(F.col(n) == 0, 0.0).otherwise(F.col("both") / F.col(n)), 6)
    return x.select("item_id", "doc_id", share("a").alias("precision"), share("f").alias("recall"))


def _states(spark: SparkSession, at: str) -> DataFrame:
    """Each pair's state before and after: the fact's first two words are current, the answer's second and third stale."""
    x = _pairs(spark, at)
    cur = F.array(F.array_join(F.slice(tokens(F.col("fact")), 1, 2), " "))
    old = F.array(F.array_join(F.slice(tokens(F.col("answer")), 2, 2), " "))
    control = F.col("doc_id") % 5 == 0
    after = P.currency_state(F.col("answer"), cur, old, control)
    before = P.currency_state(F.concat(F.lit("so "), F.col("fact")), cur, old, control)
    return x.select("item_id", "doc_id", control.alias("control"), before.alias("before"), after.alias("after"))


def _state_sql(answer: str) -> str:
    lead = f"coalesce(list_filter(list_transform(string_split({answer}, e'\\n\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')[1], '')"
    return _TOK.format(x=lead)


def _has(w: str, p: str) -> str:
    return f"len(list_filter(range(1, greatest(len({w}) - len({p}) + 2, 1)), lambda i: len({p}) > 0 and {w}[i:i + len({p}) - 1] = {p} and not list_has_any({w}[greatest(i - 2, 1):i - 1], [{_NEG}]))) > 0"


def _first(w: str, p: str) -> str:
    return f"coalesce(list_min(list_filter(range(1, len({w}) + 1), lambda i: {w}[i:i + len({p}) - 1] = {p})) + len({p}) - 1, len({w}) + 1)"


def _case(w: str) -> str:
    c, o = _has(w, "cur"), _has(w, "old")
    return f"case when {c} and {o} then case when not control and {_first(w, 'cur')} < {_first(w, 'old')} then 'current' else 'hedged' end when {c} then 'current' when {o} then 'stale' else 'missing' end"


_STATES = f"""{_PAIRS}, tok as materialized (select item_id, doc_id, doc_id % 5 = 0 as control, {_TOK.format(x='fact')}[1:2] as cur, {_TOK.format(x='answer')}[2:3] as old, {_state_sql('answer')} as wa, {_state_sql("'so ' || fact")} as wb from pairs),
states as materialized (select item_id, doc_id, control, {_case('wb')} as before, {_case('wa')} as after from tok)"""


@R.query(f"with {_STATES} select * from states")
def dcs_states(spark: SparkSession, at: str) -> DataFrame:
    return _states(spark, at)


@R.query(f"""with {_STATES}, a as (select count(*) filter (not control) as affected, count(*) filter (control) as control, count(*) filter (not control and after = 'current') as cur, count(*) filter (not control and after = 'stale') as stale, count(*) filter (not control and after = 'hedged') as hedged, count(*) filter (not control and after = 'missing') as missing,
count(*) filter (not control and before = 'stale') as eligible, count(*) filter (not control and before = 'stale' and after = 'current') as flipped, count(*) filter (control and before = 'current' and after = 'current') as stable from states),
r as (select affected, control, eligible, case when affected = 0 then 0 else cur / affected end as currency, case when affected = 0 then 0 else stale / affected end as stale_leak, case when affected = 0 then 0 else hedged / affected end as hedge, case when affected = 0 then 0 else missing / affected end as miss, case when eligible = 0 then 0 else flipped / eligible end as adoption, case when control = 0 then 0 else stable / control end as stability from a),
x as (select *, case when eligible = 0 then currency else adoption end as ad from r)
select affected, control, eligible, round(currency, 6) as currency, round(stale_leak, 6) as stale_leak, round(hedge, 6) as hedge, round(miss, 6) as miss, round(adoption, 6) as adoption, round(stability, 6) as stability, round(case when control = 0 then currency when affected = 0 then stability when ad + stability = 0 then 0 else 2 * ad * stability / (ad + stability) end, 6) as dcs from x""")
def dcs_report(spark: SparkSession, at: str) -> DataFrame:
    x = E.dcs_report(_states(spark, at))
    return x.withColumns({c: F.round(c, 6) for c, t in x.dtypes if t == "double"})


@R.query("with e as (select o_orderkey as id, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderkey % 10 <> 3), a as (select o_orderkey as id, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 11 = 0 then null else o_totalprice end as o_totalprice, o_orderpriority from orders where o_orderkey % 10 <> 4), j as (select coalesce(e.id, a.id) as id, e.id as ei, a.id as ai, e.o_orderstatus is distinct from a.o_orderstatus as d1, e.o_totalprice is distinct from a.o_totalprice as d2 from e full join a on e.id = a.id) select id, 'missing' as kind, null as field from j where ai is null union all select id, 'extra', null from j where ei is null union all select id, 'differs', 'o_orderstatus' from j where ei is not null and ai is not null and d1 union all select id, 'differs', 'o_totalprice' from j where ei is not null and ai is not null and d2")
def graph_diff(spark: SparkSession, at: str) -> DataFrame:
    o = table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    a = o.where("id % 10 <> 4").withColumns({"o_orderstatus": F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("id") % 11 != 0, F.col("o_totalprice"))})
    return E.graph_diff(o.where("id % 10 <> 3"), a, ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@R.query("select doc_id as answer_id, source || '.md' as raw, true as found from documents union all select doc_id, 'nowhere', false from documents where doc_id % 2 = 0 union all select doc_id, 'c' || doc_id, true from documents where doc_id % 2 = 0")
def citation_check(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" [nowhere, c"), F.col("doc_id").cast("string"), F.lit("]"))).otherwise("")
    a = d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("As said (“"), F.col("source"), F.lit(".md”)"), end).alias("answer"))
    c = d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.col("source"), F.lit(".md")).alias("file_name"), F.lit("").alias("file_path"))
    return E.citations(a, c)


def _hits(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    x = chunks(spark, at)
    q = spark.sql("select * from values (0, 'the thing'), (1, 'idiot scum'), (2, 'license version') as t(query_id, query)")
    hits = L.bm25(x, q, 30).join(x.select("id", F.col("ref_doc_id").alias("doc")), "id")
    rel = x.join(table(spark, at, "labels").where("quality = 1"), F.col("id") == F.col("doc_id")).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("query_id"), F.col("ref_doc_id").alias("doc"))
    return hits, rel


_HITS = f"""{CHUNKS}, {bm25_sql('h0', 'the thing', 30)}, """ + ", ".join(
    bm25_sql(f"h{k}", q, 30).replace("tok as", f"tok{k} as").replace("from tok", f"from tok{k}").replace("stats as", f"stats{k} as").replace(", stats group", f", stats{k} group").replace("post as", f"post{k} as").replace("from post", f"from post{k}").replace("dfs as", f"dfs{k} as").replace("join dfs", f"join dfs{k}").replace("scored as", f"scored{k} as").replace("from scored", f"from scored{k}")
    for k, q in ((1, "idiot scum"), (2, "license version"))
)
_REC = f"{_HITS}, hits as (select 0 as query_id, rank, ref_doc_id as doc from h0 join chunks using (id) union all select 1, rank, ref_doc_id from h1 join chunks using (id) union all select 2, rank, ref_doc_id from h2 join chunks using (id)), rel as (select distinct q as query_id, ref_doc_id as doc from chunks join labels on id = doc_id, (values (0), (1)) v(q) where quality = 1), tot as (select query_id, count(*) as total from rel group by 1), f as (select query_id, count(distinct doc) as docs, count(*) as rows from hits where rank <= 20 and exists (select 1 from rel r where r.query_id = hits.query_id and r.doc = hits.doc) group by 1)"


@R.query(f"with {_REC} select q.query_id, round(case when total is null then 1.0 else coalesce(docs, 0) / total end, 6) as recall from (select distinct query_id from hits) q left join tot using (query_id) left join f using (query_id)")
def recall_at_k_docs(spark: SparkSession, at: str) -> DataFrame:
    return E.recall_at_k(*_hits(spark, at), 20).withColumn("recall", F.round("recall", 6))


@R.query(f"with {_REC} select q.query_id, round(case when total is null then 1.0 else coalesce(rows, 0) / total end, 6) as recall from (select distinct query_id from hits) q left join tot using (query_id) left join f using (query_id)")
def recall_at_k_chunks(spark: SparkSession, at: str) -> DataFrame:
    return E.recall_at_k(*_hits(spark, at), 20, distinct=False).withColumn("recall", F.round("recall", 6))


@R.query("with q as (select item_id as question_id, item_id % 3 as type, [item_id * 5, item_id * 5 + 1] as expected from benchmark), x as (select question_id, unnest(expected) as doc from q) select question_id, type from q where not exists (select 1 from x where x.question_id = q.question_id and x.doc not in (select doc_id from documents where doc_id % 4 <> 0)) qualify row_number() over (partition by type order by question_id) <= 4")
def slice_questions(spark: SparkSession, at: str) -> DataFrame:
    q = table(spark, at, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 3).alias("type"), F.array(F.col("item_id") * 5, F.col("item_id") * 5 + 1).alias("expected_doc_ids"), F.col("item_id").alias("position"))
    kept = table(spark, at, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("doc"))
    return E.limit_per_type(E.gold_subset(q, kept), 4).select("question_id", "type")


@R.query("with m as (select source, unnest(list_distinct([source, lang])) as s, quality = 1 as passed from documents d join labels l on d.doc_id = l.doc_id) select s as source, count(*) filter (passed) as passed, count(*) as total, round(count(*) filter (passed) / count(*), 6) as rate from m group by s")
def qa_hit_rates(spark: SparkSession, at: str) -> DataFrame:
    d = table(spark, at, "documents").join(table(spark, at, "labels"), "doc_id")
    return E.hit_rates(d.select(F.array("source", "lang").alias("sources"), (F.col("quality") == 1).alias("passed"))).withColumn("rate", F.round("rate", 6))


@R.query("select source, cast(sum(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end) as bigint) as tokens from documents group by source")
def token_cost(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").groupBy("source").agg(F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
