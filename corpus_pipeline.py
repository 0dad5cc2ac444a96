"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, mixing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, language, mixing, nearjoin, secrets
from spanloom.llm.common import stage_table, table

#: Documents whose best language is less likely than this are rejected, as are those without a letter.
MIN_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; learns from the labels of the input itself."""
    columns = docs.columns
    model = language.train(docs, F.col("doc_id"))
    known = (F.col("__lang_pred") != "und") & (F.col("__score") >= MIN_SCORE)
    return language.predict(docs, model, lang_pred="__lang_pred", score="__score").filter(known).select(*columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies: 5-word Jaccard of 0.8 or more."""
    return nearjoin.deduplicate(docs, k=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with how often and how many words. Own columns of the added names are replaced;
    rows get a written number to join back on, as ids may repeat or lack."""
    numbered = stage_table(docs.drop("size", "source_size", "target", "copies", "taken").withColumn("__row", F.monotonically_increasing_id()))
    mixed = mixing.mix(numbered, carry=("__row",)).filter("copies > 0").select("__row", "size", "source_size", "target", "copies", "taken")
    return numbered.join(mixed, "__row").drop("__row")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", scan_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: The language stage is a trained model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
