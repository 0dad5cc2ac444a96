"""Mixing sources to target weights by entropy balancing.

A document of z words gets a rate r, the expected number of its copies. Among all rates up to ``max_copies`` that
give each source its target number of words, sum(z * r) = T, the balanced ones have the least relative entropy
to "take every document once", sum(w * (r * ln r - r)). A document weighs w = z ** WEIGHT_POWER: with power 0
documents count alike, and a source that shrinks would lose nearly all its long ones; with 1 words count
alike, and all rates of a source would be equal. The dual has one multiplier for each source's constraint and is
convex; its solution tilts every document's rate exponentially, r = exp(l * z / w), cut at ``max_copies``.

Newton steps solve the dual: each sums the gradient and the curvature of all constraints over the distributed table
of (source, size) counts, which hold all that the sums need of the documents, and writes the new multipliers.
A step that leaves the bracket known so far is replaced by the bracket's middle. The tilted rates are then
rounded into whole copies, in order of size, and what is left to the target is mended with copies of the
smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage_table

#: Source weights by code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_COPIES = 3
WEIGHT_POWER = 0.5
#: Phase of the systematic rounding; off any simple fraction, so that rates such as 1/2 give no ties.
PHASE = 0.41421356
#: A multiplier is solved by a Newton step smaller than STEP (its error then is near the step's square), or by a bracket
#: smaller than WIDTH; rates are made from multipliers of DIGITS decimals.
STEP, WIDTH, DIGITS = 1e-9, 1e-13, 10
#: The bracket halves at least every other step: a bound against a loop that never ends, not a limit that is met.
MAX_STEPS = 200
#: Sums are exact in decimals, whatever their order.
EXACT = "decimal(38,8)"


def targets(sources: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: shares by weight of the sum of all sizes, none above
    ``max_copies`` times its source's size; the excess is shared again by weight (water filling).

    A sum of 0 gives targets of 0. Works on one row for each source only.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # by the share at which a source is full; ties by source
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * max_copies)
        .withColumn("_total", F.sum("source_size").over(all_rows))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # the first source that its share doesn't fill sets the level for all after it
        .withColumn("_open", F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_wleft"))
    )
    first = F.min(F.when(F.col("_open"), F.struct(F.row_number().over(order).alias("k"), F.col("_left").alias("l"), F.col("_wleft").alias("w")))).over(all_rows)
    df = df.withColumn("_k", F.row_number().over(order)).withColumn("_first", first)
    share = (F.col("_first.l") * F.col("_w")).cast("double") / F.col("_first.w").cast("double")
    return df.select("source", "source_size", F.when(F.col("_k") < F.col("_first.k"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def tilt_of(size: Column) -> Column:
    """z / w: how strongly a document's rate follows its source's multiplier."""
    return F.pow(size.cast("double"), F.lit(1 - WEIGHT_POWER))


def rate_of(size: Column, multiplier: Column, max_copies: int = MAX_COPIES) -> Column:
    """The tilted rate of documents of a size; 0 without words, ``max_copies`` for an infinite multiplier."""
    return F.when(size > 0, F.least(F.lit(float(max_copies)), F.exp(multiplier * tilt_of(size)))).otherwise(F.lit(0.0))


def balance(sizes: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, multiplier) that solve the dual for ``sizes(source, size, n)`` and ``goals(source, source_size, target)``.

    Sources without words get null; a target of 0 gives -infinity (rates 0), one of max_copies * source_size infinity.
    """
    inf = F.lit(float("inf"))
    full = F.col("target") >= F.col("source_size") * max_copies
    fixed = F.when(F.col("source_size") == 0, F.lit(None).cast("double")).when(F.col("target") <= 0, -inf).when(full, inf)
    easy = (F.col("source_size") == 0) | (F.col("target") <= 0) | full
    solved = goals.filter(easy).select("source", fixed.alias("multiplier"))
    terms = sizes.filter("size > 0").select(F.col("source").alias("_s"), "size", (F.col("n") * F.col("size")).alias("m"))
    # the right multiplier if all documents had their mean tilt
    tilts = terms.groupBy("_s").agg((F.sum((F.col("m") * tilt_of(F.col("size"))).cast(EXACT)).cast("double") / F.sum("m")).alias("tilt"))
    state = goals.filter(~easy).join(tilts, F.col("source").eqNullSafe(F.col("_s")))
    start = F.log(F.col("target") / F.col("source_size")) / F.col("tilt")
    state = state.select("source", "target", start.alias("l"), (-inf).alias("lo"), inf.alias("hi"), F.lit(False).alias("done"))
    for _ in range(MAX_STEPS):
        state = stage_table(state)
        if state.filter("NOT done").isEmpty():
            break
        met = terms.join(state.filter("NOT done"), F.col("source").eqNullSafe(F.col("_s")))
        rate = rate_of(F.col("size"), F.col("l"), max_copies)
        inner = F.exp(F.col("l") * tilt_of(F.col("size"))) < max_copies
        sums = met.groupBy("source").agg(
            F.sum((F.col("m") * rate).cast(EXACT)).cast("double").alias("f"),
            F.sum(F.when(inner, F.col("m") * rate * tilt_of(F.col("size"))).otherwise(F.lit(0.0)).cast(EXACT)).cast("double").alias("g"),
        ).select(F.col("source").alias("_s"), "f", "g")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        lo = F.when(F.col("f") < F.col("target"), F.col("l")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") > F.col("target"), F.col("l")).otherwise(F.col("hi"))
        now = now.withColumn("lo", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        step = F.try_divide(F.col("target") - F.col("f"), F.col("g"))
        middle = (
            F.when(F.isnan(F.col("lo") + F.col("hi")), F.lit(0.0))
            .when(F.col("lo") == -inf, F.col("hi") * 2 - 1).when(F.col("hi") == inf, F.col("lo") * 2 + 1)
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        newton = F.col("l") + step
        inside = step.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        at = F.when(F.col("f") == F.col("target"), F.col("l")).when(inside, newton).otherwise(middle)
        end = (F.abs(at - F.col("l")) < F.when(inside, STEP).otherwise(WIDTH)) | (F.col("hi") - F.col("lo") < WIDTH)
        state = now.select("source", "target", F.when(F.col("done"), F.col("l")).otherwise(at).alias("l"), "lo", "hi", (F.col("done") | end).alias("done"))
    return solved.union(state.select("source", F.round("l", DIGITS).alias("multiplier")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_copies: int = MAX_COPIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mixes documents to their sources' target tokens.

    Returns one row per input row: id_col, size, source_size, target, rate (the document's tilted rate), copies and taken
    (copies * size). Other columns than ``carry`` are not carried. Null or empty texts have size 0 and no copies; a null
    source is a source of its own, last in order; repeated ids are documents of their own; ties between equal
    rows may fall either way; an empty table gives no rows. Reruns agree: order is by size, then md5 of the id.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *carry)
    # 4096 sub-groups for each source and size keep hot groups apart
    slim = stage_table(slim)  # the texts are read once
    slim = slim.withColumn("_md", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))).withColumn("_h", F.substring("_md", 1, 3))
    cells = slim.groupBy("source", "size", "_h").agg(F.count("*").alias("n"))
    sizes = stage_table(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = stage_table(targets(sources, max_copies=max_copies))
    multipliers = balance(sizes, goals, max_copies).select(F.col("source").alias("_m"), "multiplier")
    solved = goals.join(multipliers, F.col("source").eqNullSafe(F.col("_m"))).select(F.col("source").alias("_s"), "source_size", "target", "multiplier")

    # systematic rounding over the sizes of a source, largest first
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per_source = Window.partitionBy("source")
    due = (F.col("rate") * F.col("n")).cast(EXACT)
    to = F.floor(F.sum(due).over(down) + F.lit(PHASE).cast(EXACT))
    since = F.floor(F.sum(due).over(down) - due + F.lit(PHASE).cast(EXACT))
    sizes = (
        sizes.join(solved, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("rate", rate_of(F.col("size"), F.col("multiplier"), max_copies))
        .withColumn("_k", F.when(F.col("size") > 0, F.least(to - since, F.col("n") * max_copies)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.round(F.col("target")).cast("long") - F.sum(F.col("_k") * F.col("size")).over(per_source))
        # copies that the group can still gain or lose
        .withColumn("_room", F.when(F.col("_rest") >= 0, F.col("n") * max_copies - F.col("_k")).otherwise(F.col("_k")))
        .withColumn("_used", F.coalesce(F.sum(F.col("_room") * F.col("size")).over(up), F.lit(0)))
        .withColumn("_more", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("_room"), F.floor((F.abs("_rest") - F.col("_used")) / F.greatest(F.col("size"), F.lit(1)))))).otherwise(F.lit(0)))
        .withColumn("_k", F.col("_k") + F.col("_more") * F.signum(F.col("_rest")).cast("long"))
    )
    sizes = sizes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", F.col("n").alias("_n"), "_k")

    # the documents of a group get its copies evenly, in order of md5
    in_group = Window.partitionBy("source", "size").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("n").over(in_group), F.lit(0))).drop("n")
    cells = cells.join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    cells = cells.select("_s", "_z", F.col("_h").alias("_b"), "source_size", "target", "rate", "_n", "_k", "_before")
    j = F.col("_before") + F.row_number().over(Window.partitionBy("source", "size", "_h").orderBy("_md", "_id", *carry))
    return (
        slim.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_h") == F.col("_b")))
        .withColumn("_j", j)
        .withColumn("copies", (F.expr("(_j * _k) div _n") - F.expr("((_j - 1) * _k) div _n")).cast("long"))
        .select(F.col("_id").alias(id_col), *carry, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op4_entropy_mix(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).drop("rate", "copies")


#: The multipliers by halving brackets, and then the same rounding.
OP4_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS md FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l,
        (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wl FROM w),
f AS (SELECT min(k) AS k, min_by(l, k) AS l, min_by(wl, k) AS wl FROM o WHERE l * w <= cap * wl),
t AS (SELECT o.source, source_size, CASE WHEN o.k < f.k THEN cap::DOUBLE ELSE (f.l * w)::DOUBLE / f.wl::DOUBLE END AS target FROM o, f),
z AS MATERIALIZED (SELECT d.source, size, count(*) AS n, any_value(source_size) AS source_size, any_value(target) AS target
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, size),
h AS (SELECT source, 0 AS i, -64::DOUBLE AS lo, 64::DOUBLE AS hi FROM t
      UNION ALL
      SELECT source, i + 1, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END
      FROM (SELECT h.source, h.i, h.lo, h.hi, (h.lo + h.hi) / 2 AS mid,
                   sum((z.n * z.size * least(3, exp((h.lo + h.hi) / 2 * sqrt(z.size))))::DECIMAL(38, 8)) < any_value(z.target) AS low
            FROM h JOIN z ON h.source IS NOT DISTINCT FROM z.source WHERE h.i < 60 GROUP BY h.source, h.i, h.lo, h.hi)),
x AS (SELECT source, round((lo + hi) / 2, 10) AS m FROM h WHERE i = 60),
r AS (SELECT z.*, CASE WHEN size = 0 OR target <= 0 THEN 0 WHEN target >= 3 * source_size THEN 3 ELSE least(3, exp(m * sqrt(size))) END::DOUBLE AS rate
      FROM z JOIN x ON z.source IS NOT DISTINCT FROM x.source),
c AS (SELECT *, (rate * n)::DECIMAL(38, 8) AS due, sum((rate * n)::DECIMAL(38, 8)) OVER (PARTITION BY source ORDER BY size DESC) AS c FROM r),
k AS (SELECT *, CASE WHEN size > 0 THEN least(floor(c + 0.41421356) - floor(c - due + 0.41421356), 3 * n) ELSE 0 END::BIGINT AS k0 FROM c),
e AS (SELECT *, round(target)::BIGINT - sum(k0 * size) OVER (PARTITION BY source) AS rest FROM k),
m AS (SELECT *, CASE WHEN rest >= 0 THEN 3 * n - k0 ELSE k0 END AS room FROM e),
u AS (SELECT *, coalesce(sum(room * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m),
g AS (SELECT *, (k0 + sign(rest) * CASE WHEN size > 0 THEN greatest(0, least(room, floor((abs(rest) - used) / greatest(size, 1)))) ELSE 0 END)::BIGINT AS kk FROM u),
j AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source, size ORDER BY md, doc_id) AS j FROM d)
SELECT doc_id, j.size, g.source_size, g.target, (((j * kk) // n - ((j - 1) * kk) // n) * j.size)::BIGINT AS taken
FROM j JOIN g ON j.source IS NOT DISTINCT FROM g.source AND j.size = g.size
"""
