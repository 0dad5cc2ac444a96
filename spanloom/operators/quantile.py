"""Order statistics by group, exact, without a sort of a whole group.

The values of a group are counted, and for each wanted rank the range of values that holds it is cut into cells; the cell with the
rank becomes the next range, until a cell is one value. A round aggregates cells (CELLS for each wanted rank), never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage

CELLS = 1000


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """by, n (values that are neither null nor NaN), and for each name in ``ranks`` the value at that rank (from 1), as a double. Ranks are columns
    over ``n``, the group's size; null ranks, and ranks out of 1..n, give null. A null group is one like others; a group without
    values isn't listed."""
    counts = stage(df.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").groupBy("_by", "x").agg(F.count("*").alias("c")))
    groups = stage(counts.groupBy("_by").agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("r")) for k, r in ranks.items()]))
    wanted = groups.select("_by", "n", "lo", "hi", names.alias("w")).select("_by", "w.name", "w.r", "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    todo, found = stage(wanted.filter("r BETWEEN 1 AND n").drop("n")), []
    while not todo.isEmpty():
        found.append(todo.filter("lo = hi").select("_by", "name", F.col("lo").alias("v")))
        left = todo.filter("lo < hi")
        met = counts.withColumnRenamed("_by", "_g").join(left, F.col("_g").eqNullSafe(F.col("_by")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("_g")
        # the ends lie in the first and the last cell, so that every round narrows the range, infinite ends too
        share = F.nanvl((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))
        inner = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(share * CELLS)))
        cell = F.when(F.col("x") == F.col("lo"), 0).when(F.col("x") == F.col("hi"), CELLS - 1).otherwise(inner)
        cells = met.groupBy("_by", "name", "r", "below", cell.alias("cell")).agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("_by", "name").orderBy("cell")) + F.col("below")  # over CELLS rows at most
        holds = cells.withColumn("upto", upto).filter((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("c") < F.col("r")))
        todo = stage(holds.select("_by", "name", "r", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")))
    out = groups.select(F.col("_by").alias(by), "n")
    if not found:
        return out.select("*", *[F.lit(None).cast("double").alias(k) for k in ranks])
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    wide = values.groupBy("_by").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])
    return out.join(wide, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", *ranks)


def median(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """by and the median of the values that aren't null, the mean of the two in the middle."""
    n = F.col("n")
    found = order_statistics(df, by, value, {"_lo": F.floor((n + 1) / 2), "_hi": F.floor((n + 2) / 2)})
    return found.select(by, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def exclusive_quantiles(df: DataFrame, by: str, value: str, percents: tuple[int, ...], least: int = 101) -> DataFrame:
    """by, n and p<k> for each percent: the exclusive method (rank p * (n + 1) / 100, linear between ranks), null unless
    a group has at least ``least`` values."""
    n = F.col("n")
    place = {p: p * (n + 1) for p in percents}  # in hundredths of a rank
    low = {p: F.greatest(F.lit(1), F.least(F.floor(place[p] / 100), n - 1)) for p in percents}
    ranks = {f"_{side}{p}": F.when(n >= least, low[p] + i) for p in percents for i, side in enumerate(("lo", "hi"))}
    found = order_statistics(df, by, value, ranks)
    between = {p: place[p] - low[p] * 100 for p in percents}
    return found.select(by, "n", *[((F.col(f"_lo{p}") * (100 - between[p]) + F.col(f"_hi{p}") * between[p]) / 100.0).alias(f"p{p}") for p in percents])
