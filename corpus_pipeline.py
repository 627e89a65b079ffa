"""The corpus pipeline: toxic texts go, then texts of no language, near copies, repeated passages; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, packing, repeats, similar, toxicity
from tessera.llm.queries import OP8_SIZES, fitted_chain
from tessera.session import ensure_checkpoint_dir, make_importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose nearest profile is farther off than this score is of no learned language.
LEAST_LANGUAGE_SCORE = 0.2
#: Repeats of so many bytes are cut, and those of over 50 words that take fewer.
REPEAT_BYTES, REPEAT_WORDS = 256, 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it learns from the labels table."""
    make_importable(spark, give_back=True)
    docs = docs.select(COLUMNS)
    chain = fitted_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_toxicity(docs, "text", chain, "toxic").where("not toxic").select(COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know, learned from the documents' own lang."""
    make_importable(spark, give_back=True)
    docs = docs.select(COLUMNS)
    ranked = language.profiles(docs, "text", "lang")
    found = language.with_language(docs, "text", ranked)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts or texts of similarity 0.8 over five-word shingles."""
    make_importable(spark, give_back=True)
    return similar.one_of_each(docs.select(COLUMNS), "doc_id", "text").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of REPEAT_BYTES or REPEAT_WORDS and more that occur elsewhere too; n_chars follows the text."""
    make_importable(spark, give_back=True)
    out = repeats.without_repeats(docs.select(COLUMNS), "text", REPEAT_BYTES, REPEAT_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its bin, the bin's length and its place in the bin."""
    make_importable(spark, give_back=True)
    return packing.best_fit(docs, "doc_id", packing.word_count(F.col("text")), OP8_SIZES).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_dedup", drop_near_copies), ("repeat_removal", cut_repeats), ("packing", pack)]
#: Fingerprints, suffix order and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written to the shared folder and read again."""
    at = ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{at}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
