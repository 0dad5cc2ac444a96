"""Round trips of sinks and sources, over the derived tables; files go below the folder that the cluster shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset
from ..operators.tables import fresh_path, stage
from ..sources import io
from .fixtures import collector, sql
from .latin import Latin
from .q_dataset import split_windows
from .q_decode import _places
from .q_score import CONTENT, STRIDE

D = Latin(dataset)
QUERIES: dict = {}
ORACLES: dict = {}
query = collector(QUERIES, ORACLES)


# every third book also lies in the flat layout, with another text, which the nested file must hide; every fifth only there
@query("SELECT doc_id::VARCHAR AS book_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'flat ' ELSE '' END || coalesce(text, '') AS t FROM documents) WHERE t <> ''")
def books_round_trip(t):
    path = fresh_path(t.spark)
    books = t.texts().select(F.col("doc_id").alias("book_id"), "text")
    io.write_books(books.filter("book_id % 5 <> 0"), path)
    flat = books.filter("book_id % 3 = 0 OR book_id % 5 = 0").withColumn("text", F.concat(F.lit("flat "), F.coalesce("text", F.lit(""))))
    io.write_books(flat, path, nested=False)
    return io.read_books(t.spark, path).select("book_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


# gold spans as a map, quotes as a list, in which they are told by their place; spans without length don't come back
@query(sql("""WITH l AS (SELECT doc_id, 'Heading' AS layer, 'a' || seg_idx AS ann_id, s, CASE WHEN seg_idx % 7 = 0 THEN s ELSE e END AS e FROM gold
UNION ALL SELECT doc_id, 'Quote', (row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1)::VARCHAR, s, e FROM other WHERE layer = 'quote')
SELECT doc_id::VARCHAR AS book_id, layer, ann_id, s, e FROM l WHERE e > s""", "gold", "other"))  # fmt: skip
def layers_round_trip(t):
    path = fresh_path(t.spark)
    gold = t.gold().select(F.col("doc_id").alias("book_id"), F.lit("Heading").alias("layer"), F.concat(F.lit("a"), F.col("seg_idx").cast("string")).alias("ann_id"), "s", F.when(F.col("seg_idx") % 7 == 0, F.col("s")).otherwise(F.col("e")).alias("e"))
    io.write_layers(gold, path)
    io.write_layers(t.other().filter("layer = 'quote'").select(F.col("doc_id").alias("book_id"), F.lit("Quote").alias("layer"), F.lit("").alias("ann_id"), "s", "e"), path, as_list=True)
    return io.read_layers(t.spark, path)


# spans come back in order, ends half-open again
@query(sql("SELECT doc_id::VARCHAR AS book_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS pred_ix, s, e FROM pred", "pred"))
def prediction_round_trip(t):
    path = fresh_path(t.spark)
    io.write_predictions(t.pred(), path, "doc_id")
    return io.read_predictions(t.spark, path)


@query(sql("SELECT doc_id::VARCHAR AS book_id, seg_idx::VARCHAR AS ann_id, s::INT AS s, e::INT AS e FROM raw WHERE seg_idx % 7 <> 0", "raw"))
def sidecar_round_trip(t):
    path = fresh_path(t.spark)
    rows = t.raw().select(
        F.col("doc_id").alias("book_id"), F.lit("old").alias("batch"), F.col("seg_idx").alias("ann_id"), F.col("s").alias("raw_start"), F.col("e").alias("raw_end"), F.col("s").alias("start"), F.col("e").alias("end"),
        F.lit("keep").alias("action"), F.when(F.col("seg_idx") % 7 == 0, "True").otherwise("False").alias("dropped"), F.lit("").alias("reason"),
    )
    io.write_table(rows, path)
    return io.read_sidecar(t.spark, path)[0].select("book_id", "ann_id", "s", "e")


@query(sql("SELECT doc_id::VARCHAR AS book_id, CASE split WHEN 'val' THEN 'validation' ELSE split END AS split FROM prior", "prior"))
def split_file_round_trip(t):
    path = fresh_path(t.spark)
    io.write_table(t.prior().select(F.col("doc_id").alias("book_id"), "split"), path)
    return io.read_split_file(t.spark, path).select("book_id", "split")


@query(sql("SELECT doc_id::VARCHAR AS book_id, seg_idx AS window_index, s + 5 AS s, e + 5 AS e FROM gold", "gold"))
def window_dump_round_trip(t):
    path = fresh_path(t.spark)
    span = F.array(F.array("s", "e"))
    rows = t.gold().select(F.col("doc_id").cast("string").alias("book"), F.col("seg_idx").alias("window_index"), F.lit(5).alias("token_start"), F.lit(0).alias("char_start"), span.alias("gold"), span.alias("viterbi"))
    io.write_window_dump(rows, path)
    return io.read_window_dump(t.spark, path, "viterbi_tok").select("book_id", "window_index", "s", "e")


@query(sql("SELECT doc_id, seg_idx, s, CASE WHEN seg_idx % 3 = 0 THEN s ELSE e END AS e FROM gold WHERE seg_idx % 3 <> 0", "gold"))
def split_zero_length(t):
    spans = t.gold().select("doc_id", "seg_idx", "s", F.when(F.col("seg_idx") % 3 == 0, F.col("s")).otherwise(F.col("e")).alias("e"))
    return io.split_zero_length(spans)[0]


@query()
def windows_round_trip(t):
    path = fresh_path(t.spark)
    io.write_windows(split_windows(t), path, {0: "O", 1: "B", 2: "I"})
    return t.spark.read.parquet(f"{path}/windows").select("doc_id", "window_index", "split", F.size("input_ids").alias("n"))


@query()
def stats_report(t):
    listed = t.texts().join(t.prior().select("doc_id", "split"), "doc_id").join(t.books().select("doc_id", "batch"), "doc_id")
    tokens = D.tokenize(D.with_spans(listed, t.gold()), lambda: _places, carry=("split", "batch", "span_s", "span_e"))
    books = D.book_totals(D.label_in_rows(tokens, ("doc_id", "split", "batch", "span_s")), ("doc_id", "split", "batch"), CONTENT, STRIDE)
    sums = [F.sum(c).alias(c) for c in ("spans", "spans_without_b", "windows", "c0", "c1", "c2")]
    totals = stage(books.groupBy("split").agg(F.count("*").alias("docs"), F.count_if(F.col("batch") == "old").alias("old"), F.count_if(F.col("batch") == "new").alias("new"), *sums))  # a row for each split
    counts = totals.select("split", F.posexplode(F.array("c0", "c1", "c2")).alias("label", "n"))
    weights = reduce(DataFrame.unionByName, [D.class_weights(counts, x).withColumn("scheme", F.lit(x)) for x in ("balanced", "inv", "sqrt_inv")])
    return io.stats_report(counts, weights, totals.drop("c0", "c1", "c2"))


@query()
def split_report(t):
    from ..operators import groups as G
    from ..operators import sharing
    from .q_decode import excluded_books
    from .q_sharing import needles_held, weighted

    H = Latin(sharing)

    needles, holders = needles_held(t)
    prior, path = t.prior(), fresh_path(t.spark)
    # the report is on the split that is made, not on the one before
    split = stage(G.leak_aware_split(weighted(t), stage(H.connecting_links(needles, holders)), prior))
    groups = split.select("doc_id", "group_id")
    fixed = stage(G.resolve_fixed_splits(groups, prior))
    H.linked_books(needles, holders, ends=split).write.parquet(f"{path}/links")
    links = t.spark.read.schema("a bigint, b bigint, split_a string, split_b string").parquet(f"{path}/links")
    boilerplate = H.boilerplate_links(H.linking_shares(needles, holders, "audit"), links.select("a", "b"))
    train = holders.join(split.filter("split = 'train'").select(F.col("doc_id").alias("other")), "other", "left_semi")
    leak = H.leakage_rate(needles, H.one_match(needles, train), split)
    conflicts = groups.join(fixed.filter("n_splits > 1").select("group_id", F.col("split").alias("to")), "group_id").select("group_id", "doc_id", "to")
    tables = {
        "straddle": links.filter("NOT (split_a <=> split_b)"), "boilerplate_links": boilerplate,
        "conflicts": conflicts, "moved": G.moved_books(groups, fixed, prior), "excluded": excluded_books(t),
    }
    return io.split_report(G.split_stats(split, weighted(t), t.gold(), prior), leak, links, tables=tables, path=path, groups=groups)
