"""Selections and checks: what a job expects of its input, with all problems reported at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_books(books: DataFrame, condition: Column, limit: int | None = None, book: str = "doc_id") -> DataFrame:
    """Books that meet the condition; with ``limit`` the first ones by id (for trial runs)."""
    df = books.filter(condition)
    return df if limit is None else df.orderBy(book).limit(limit)


def _fail_if(df: DataFrame, problems: list[tuple[Column, str]]) -> DataFrame:
    """``df`` of one row; the job fails with all messages whose condition holds."""
    texts = F.concat_ws("; ", *[F.when(c, F.lit(m)) for c, m in problems])
    return df.withColumn("_ok", F.when(texts != "", F.raise_error(texts).cast("boolean")).otherwise(F.lit(True)))


def exclude_books(splits: DataFrame, ids: DataFrame, book: str = "doc_id", split: str = "split", train: str = "train") -> DataFrame:
    """``splits`` without the listed train books. Ids that are listed twice, unknown, or not in train fail the job."""
    known = splits.select(F.col(book).alias("_b"), F.col(split).alias("_s"))
    listed = ids.select(F.col(book).alias("_i")).groupBy("_i").agg(F.count("*").alias("_n")).join(known, F.col("_i") == F.col("_b"), "left")
    bad = listed.select(F.col("_i"), F.when(F.col("_n") > 1, "listed twice").when(F.col("_b").isNull(), "unknown").when(F.col("_s") != train, "not in train").alias("_why"))
    # a bad id fails the anti-join's build side
    checked = bad.select(F.when(F.col("_why").isNull(), F.col("_i")).otherwise(F.raise_error(F.concat(F.lit("excluded book "), F.col("_i").cast("string"), F.lit(": "), F.col("_why"))).cast(splits.schema[book].dataType)).alias("_i"))
    return splits.join(checked, F.col(book) == F.col("_i"), "left_anti")


def missing_books(expected: DataFrame, got: DataFrame, book: str = "doc_id") -> DataFrame:
    """Expected ids that are absent."""
    return expected.select(book).distinct().join(got, book, "left_anti")


def restrict_to_split(books: DataFrame, splits: DataFrame, book: str = "doc_id") -> DataFrame:
    """Listed books only, with their split. A book that the table lists twice fails the job; a null id is in no split."""
    listed = splits.groupBy(F.col(book).alias("_b")).agg(F.count("*").alias("_n"), F.first("split").alias("split"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("book listed twice: "), F.col("_b").cast("string")))).otherwise(F.col("split"))
    return books.join(listed.select("_b", once.alias("split")), F.col(book) == F.col("_b")).drop("_b")


def check_totals(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """One row of the totals (name -> aggregate); the job fails, naming all, if one differs from its expected value."""
    totals = df.agg(*[c.cast("long").alias(k) for k, (c, _) in expected.items()])
    problems = [(F.col(k) != v, f"{k} is not {v}") for k, (_, v) in expected.items()]
    return _fail_if(totals, problems).filter("_ok").drop("_ok")


def check_totals_against(df: DataFrame, names: dict[str, Column], frozen: DataFrame) -> DataFrame:
    """As check_totals, with the expected values in a table (name, value)."""
    totals = df.agg(*[c.cast("long").alias(k) for k, c in names.items()])
    stacked = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in names])).alias("x")).select("x.name", "x.value")
    return stacked.join(frozen.withColumnRenamed("value", "expected"), "name", "left").select("name", "value", "expected", F.col("value").eqNullSafe(F.col("expected")).alias("ok"))
