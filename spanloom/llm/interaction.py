"""Filter interaction audit: which filter removes what, in every order of the filters.

A document fails some of the filters; the set of them is its mask, a number of one bit a filter. Per part (source)
the table of masks holds 2 ** filters counts at most, and all else follows from it:

* a coalition of filters removes the documents that fail any of it: v(S), the sum over the masks that meet S;
* the step that adds filter f to the filters S before it removes v(S + f) - v(S) documents; differences of the same
  kind count good and toxic ones;
* the Shapley value of the filters is the exact solution of a constrained least-squares problem: among all phi with
  sum(phi) = v(all), it minimises the sum over the coalitions S (neither empty nor all) of
  k(S) * (v(S) - sum of phi over S) ** 2 with the Shapley kernel k(S) = (n - 1) / (C(n, |S|) * |S| * (n - |S|)).
  Its normal equations, bordered by the constraint, depend on the filters' number alone, so they are solved once, in
  rationals, with each coalition's removal as a right-hand side of its own; the solution times the number of orders is
  whole, and Spark applies it to every part's removals in whole numbers.

Only rows of (id, digest of the text, mask) are shuffled, no texts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Parameters of the five filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text with these words fails A (few words), B (few distinct words), C (capitals), D (symbols)."""
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * n,
        100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text),
        F.length(F.translate(text, SYMBOLS, "")) < F.length(text),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic), one row per row of ``docs(doc_id, text, source)``: bit i of the mask tells whether the
    document fails filter i of FILTERS. ``labels(doc_id, quality, toxic)`` may hold several rows of an id: a
    document is good (toxic) if any of them says so.

    Null texts are empty, null sources the part of the empty string. A document fails E if its text is that of a document with a
    smaller id: rows of one id don't make each other fail, and null ids are neither smaller nor larger than others and have no
    labels. Texts are the same if their SHA-256 digests are.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    flags = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("text"), F.col("words")))]
    rows = stage_table(words.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), sum(flags[1:], flags[0]).alias("mask")))
    known = rows.filter(F.col("doc_id").isNotNull())
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = known.join(said, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    flag = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name) for c, name in (("good", "good"), ("bad", "toxic"))]
    unknown = rows.filter(F.col("doc_id").isNull()).select("part", "mask", *[F.lit(0).cast("long").alias(c) for c in ("good", "toxic")])
    return judged.select("part", (F.col("mask") + copy).cast("int").alias("mask"), *flag).unionByName(unknown)


def removals(masks: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """Per part: ``all``, ``good`` and ``toxic``, arrays of 2 ** n counts of the documents that the coalition with that number
    removes, and ``total``. ``masks(part, mask, good, toxic)`` is summed to 2 ** n counts a part before anything else."""
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("all"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def removed(of: str, coalition: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(coalition) != 0, F.col(of))), F.lit(0))

    return counts.groupBy("part").agg(F.sum("all").alias("total"), *[F.array(*[removed(of, s) for s in range(1 << n)]).alias(of) for of in ("all", "good", "toxic")])


def shapley_solution(n: int) -> list[list[int]]:
    """For n filters the whole numbers c with n! * phi[f] = sum over S of c[f][S] * v(S): the kernel-weighted normal equations
    under the efficiency constraint, solved by exact elimination."""
    full = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    member = [[s >> f & 1 for f in range(n)] for s in range(full + 1)]
    # unknowns: phi and the multiplier of the constraint; right-hand sides: one column for each coalition
    system = [[sum((k * member[s][f] * member[s][g] for s, k in kernel.items()), Fraction(0)) for g in range(n)] + [Fraction(1)] + [kernel.get(s, Fraction(0)) * member[s][f] for s in range(full + 1)] for f in range(n)]
    system.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == full)) for s in range(full + 1)])
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if system[r][i])
        system[i], system[pivot] = system[pivot], system[i]
        system[i] = [x / system[i][i] for x in system[i]]
        for r in range(n + 1):
            if r != i and system[r][i]:
                system[r] = [x - system[r][i] * y for x, y in zip(system[r], system[i], strict=True)]
    scaled = [[x * factorial(n) for x in row[n + 1 :]] for row in system[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the solution isn't whole")
    return [[int(x) for x in row] for row in scaled]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (summed over all orders). Nulls and repeats as in ``failure_masks``; an empty table gives
    no rows."""
    n = len(FILTERS)
    parts = stage_table(removals(failure_masks(docs, labels), n))
    solution = shapley_solution(n)
    shapley = [sum((F.col("all")[s] * c for s, c in enumerate(row) if c), F.lit(0)).cast("long") for row in solution]
    steps = [
        f"struct('{order}', {k + 1}, {sum(1 << f for f in chosen[:k])}, {1 << chosen[k]})"
        for chosen in permutations(range(n)) for order in ["".join(FILTERS[f] for f in chosen)] for k in range(n)
    ]
    full, bit = (1 << n) - 1, F.col("bit")
    values = F.map_from_arrays(F.array(*[F.lit(1 << f) for f in range(n)]), F.array(*shapley))
    plan = F.expr(f"array({', '.join(steps)})").cast("array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = parts.withColumn("values", values).select("*", F.inline(plan)).withColumn("after", F.col("before") + bit)

    def at(of: str, mask: Column) -> Column:
        return F.element_at(of, (mask + 1).cast("int"))

    removed = at("all", F.col("after")) - at("all", F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("all", F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (at("all", bit) - removed).alias("redundant"),
        (at("all", F.lit(full)) - at("all", F.lit(full) - bit)).alias("unique_fails"),
        (at("good", F.col("after")) - at("good", F.col("before"))).alias("good_lost"),
        (at("toxic", F.col("after")) - at("toxic", F.col("before"))).alias("toxic_lost"),
        F.element_at("values", bit).alias("shapley"),
    )


def op11_filter_interaction(spark, sf_dir):
    from .common import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS_SQL = "SELECT a || b || c || d || e AS filter_order FROM f f1(a), f f2(b), f f3(c), f f4(d), f f5(e) WHERE a NOT IN (b, c, d, e) AND b NOT IN (c, d, e) AND c NOT IN (d, e) AND d <> e"
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
least AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least.least THEN 'E' ELSE '' END AS fails
  FROM w JOIN least USING (text) LEFT JOIN lab ON w.doc_id = lab.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
f(v) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS ({_ORDERS_SQL}),
s AS (SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step::INTEGER AS step, own,
  coalesce(sum(n) FILTER (WHERE translate(fails, before || own, '') = fails), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') <> fails), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
