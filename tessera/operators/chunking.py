"""From messages and texts to chunks: sessions, glued threads, sentence packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, is_small_talk, trim_space

SESSION_GAP = "24 hours"


def sessions(messages: DataFrame, keys: list[str], ts: str = "ts", gap: str = SESSION_GAP, order: list[str] | None = None) -> DataFrame:
    """messages with session: 0-based within the keys, a new one where more than the gap has passed.

    A message without time never starts one.
    """
    w = Window.partitionBy(*keys).orderBy(ts, *(order or []))
    late = F.coalesce(F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {gap}"), F.lit(False))
    return messages.withColumn("session", F.sum(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def glued_threads(messages: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk for each thread: texts in order, with speakers' names where there are several.

    messages: keys, order, user, text, ts. Blank texts go. A thread is as large as a document; its texts
    meet in one row by nature.
    """
    x = messages.withColumns({"t": trim_space(F.col("text")), "u": trim_space(F.coalesce(F.col("user"), F.lit("")))}).where("t <> ''")
    rows = F.array_sort(F.collect_list(F.struct("order", "u", "t", "text", "ts")))
    x = x.groupBy(*keys).agg(rows.alias("m"), F.min("order").alias("first"))
    speakers = F.array_distinct(F.filter(F.transform("m", lambda r: r["u"]), lambda u: u != ""))
    several = F.size(speakers) > 1
    parts = F.transform("m", lambda r: F.when(several & (r["u"] != ""), F.concat(r["u"], F.lit(": "), r["t"])).otherwise(r["text"]))
    text = F.array_join(parts, "\n\n")
    return x.select(*keys, "first", text.alias("text"), estimate_tokens(text).alias("token_count"), F.when(several, F.array_sort(speakers)).alias("speakers"))


def speakers(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, user, ts): each speaker's first message where a chunk has several speakers."""
    x = messages.where(trim_space(F.col("user")) != "").groupBy(*keys, "user").agg(F.min("ts").alias("ts"))
    return x.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1").drop("n")


def meaningful(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.where(~is_small_talk(F.col(text)))


def sentences(text: Column) -> Column:
    """Sentences by rule: a run up to an end mark and white space, or up to a blank line."""
    cut = F.regexp_replace(trim_space(text), r"([.!?…]+[\"'»”)\]]*)\s+|\n\s*\n", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), trim_space), lambda s: s != "")


def packed_sentences(sents: Column, size: int, overlap: int) -> Column:
    """Chunks of sentences: filled up to `size` tokens, each beginning with the last sentences of the one before.

    An array of texts. The sentences carried over are the fewest that hold `overlap` tokens.
    """
    kind = "struct<done:array<string>,cur:array<struct<s:string,n:int>>>"
    tokens_of = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["n"])
    items = F.transform(sents, lambda s: F.struct(s.alias("s"), estimate_tokens(s).alias("n")))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), " ")

    def tail(cur: Column) -> Column:
        if overlap <= 0:
            return F.slice(cur, 1, 0)
        # From the end, as long as what is kept so far is under the overlap.
        state = F.aggregate(F.reverse(cur), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.when(a["n"] >= overlap, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (a["k"] + 1).alias("k"))))
        return F.slice(cur, F.size(cur) - state["k"] + 1, state["k"])

    def step(a: Column, x: Column) -> Column:
        full = (tokens_of(a["cur"]) > 0) & (tokens_of(a["cur"]) + x["n"] > size)
        kept = F.struct(F.concat(a["done"], F.array(joined(a["cur"]))).alias("done"), F.concat(tail(a["cur"]), F.array(x)).alias("cur"))
        grown = F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(x)).alias("cur"))
        return F.when(full, kept).otherwise(grown)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<s:string,n:int>>").alias("cur")).cast(kind)
    return F.aggregate(items, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(joined(a["cur"])))).otherwise(a["done"]))


def text_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, text, token_count) of each document."""
    x = docs.select(F.col(id_col).alias("id"), F.posexplode(packed_sentences(sentences(F.col(text_col)), size, overlap)).alias("chunk_index", "text"))
    return x.withColumn("token_count", estimate_tokens(F.col("text")))


def sliding_counts(hits: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """hits with n: how many of the same key there are in the seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumn("n", F.count("*").over(w))
