"""Text shared verbatim between books: needles, the books that hold them, shares, links, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import TIBETAN, Profile
from .search import digest, held_keys, holders
from .spans import attach_text
from .tables import stage

MATCH_MIN = 40
K = 6
LINK_SHARE = 0.10
MIN_SHARED, MIN_SHARED_ABS = 2, 10


def needles(spans: DataFrame, books: DataFrame, profile: Profile = TIBETAN, least: int = MATCH_MIN, k: int = K, book: str = "doc_id", ident: str = "seg_idx") -> DataFrame:
    """book, needle_id, nd (squeezed text), len, syl: long spans with at least k + 2 syllables."""
    long = spans.select(book, F.col(ident).alias("needle_id"), "s", "e").filter(F.col("e") - F.col("s") >= least)
    df = attach_text(long, books, book, context=0).withColumn("nd", squeeze(F.col("seg"), profile)).withColumn("syl", T.syllables(F.col("nd"), profile))
    return df.filter(F.size("syl") >= k + 2).select(book, "needle_id", "nd", (F.col("e") - F.col("s")).alias("len"), "syl")


def squeeze(text: Column, profile: Profile) -> Column:
    """The text without white space; where white space parts the syllables, with each run of it as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ") if profile.tsheg.isspace() else T.strip_ws(text)


def verbatim_matches(needle_rows: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id", text: str = "text") -> DataFrame:
    """book, needle_id, other: the other books whose squeezed text holds a needle. Needles of one text are searched once. Its rows are
    as many as owners times holders of each text; ``links``, ``one_match`` and the like do without them."""
    return expand(keyed(needle_rows), held(needle_rows, books, profile, book, text), book)


def keyed(needle_rows: DataFrame) -> DataFrame:
    """The needles with digests (16 bytes) in place of their texts: what ``held`` gives, and all that follows needs to tell them apart."""
    return needle_rows.withColumn("nd", digest(F.col("nd")))


def held(needle_rows: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id", text: str = "text") -> DataFrame:
    """nd (the digest, as of ``keyed``), other, each once: the books whose squeezed text holds a needle's text, its own ones too. It grows
    with texts and holders."""
    return held_keys(needle_rows.select("nd"), books.select(book, squeeze(F.col(text), profile).alias("_t")), book, "_t").withColumnRenamed("key", "nd")


#: Holders of a text that meet its owners in one task at most.
PART = 4096


def expand(needle_rows: DataFrame, held_rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """verbatim_matches from ``held``: needles (a needle_id names one text of a book) are made distinct, not their matches, which
    leave the join as they are. Holders of a common text are dealt out in parts, each of which meets the owners: its matches, the
    square of a group of copies, are made by many tasks."""
    parts = held_rows.groupBy("nd").agg(F.ceil(F.count("*") / PART).alias("_parts")).filter("_parts > 1")
    own = needle_rows.select(book, "needle_id", "nd").distinct().join(parts, "nd", "left")
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), (F.coalesce("_parts", F.lit(1)) - 1).cast("int")))).drop("_parts")
    dealt = held_rows.join(parts, "nd", "left").withColumn("_part", F.pmod(F.xxhash64("other"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return own.join(dealt, ["nd", "_part"]).filter(F.col("other") != F.col(book)).select(book, "needle_id", "other")


def one_match(needle_rows: DataFrame, held_rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """book, needle_id, other: one other book for each needle that another book holds; a row for each needle at most."""
    ends = held_rows.groupBy("nd").agg(F.min("other").alias("_lo"), F.max("other").alias("_hi"))
    met = needle_rows.select(book, "needle_id", "nd").distinct().join(ends, "nd")
    return met.select(book, "needle_id", F.when(F.col("_lo") != F.col(book), F.col("_lo")).when(F.col("_hi") != F.col(book), F.col("_hi")).alias("other")).filter("other IS NOT NULL")


def pair_share(found: DataFrame, needle_rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """a, b, chars, n_shared, share: how much of a's long text (by raw length) is found in b."""
    total = needle_rows.groupBy(book).agg(F.sum("len").alias("_tot"))
    df = found.join(needle_rows.select(book, "needle_id", "len"), [book, "needle_id"]).groupBy(F.col(book).alias("a"), F.col("other").alias("b")).agg(F.sum("len").alias("chars"), F.count("*").alias("n_shared"))
    return df.join(total.withColumnRenamed(book, "a"), "a").select("a", "b", "chars", "n_shared", (F.col("chars") / F.col("_tot")).alias("share"))


def shares_of(needle_rows: DataFrame, held_rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """pair_share from ``held``: the texts of a book are counted before they meet their holders, so that pairs are dealt once."""
    own = needle_rows.groupBy(F.col(book).alias("a"), "nd").agg(F.sum("len").alias("_len"), F.count("*").alias("_n"))
    total = needle_rows.groupBy(F.col(book).alias("a")).agg(F.sum("len").alias("_tot"))
    met = own.join(total, "a").join(held_rows.withColumnRenamed("other", "b"), "nd").filter("a <> b")
    df = met.groupBy("a", "b", "_tot").agg(F.sum("_len").alias("chars"), F.sum("_n").alias("n_shared"))
    return df.select("a", "b", "chars", "n_shared", (F.col("chars") / F.col("_tot")).alias("share"))


def holding_books(needle_rows: DataFrame, held_rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """other: the books that hold a needle of another book."""
    owners = needle_rows.groupBy("nd").agg(F.min(book).alias("_lo"), F.max(book).alias("_hi"))
    return held_rows.join(owners, "nd").filter((F.col("_lo") != F.col("other")) | (F.col("_hi") != F.col("other"))).select("other").distinct()


def _unordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(n: Column, share: Column, rule: str) -> Column:
    """Whether shared needles link; what links goes on to do so with more of them."""
    big = share >= LINK_SHARE
    return big if rule == "audit" else big & (n >= MIN_SHARED) | (n >= MIN_SHARED_ABS)


def link_books(shares: DataFrame, rule: str = "split") -> DataFrame:
    """Unordered pairs of linked books. ``split``: a tenth of the text over two needles, or ten needles; ``audit``: a tenth."""
    return _unordered(shares.filter(_linked(F.col("n_shared"), F.col("share"), rule)))


def _owned(needle_rows: DataFrame, book: str) -> DataFrame:
    """book, nd, _len, _n, _tot: each text of a book, how often and how much of it there is, and the length of all its texts."""
    return needle_rows.groupBy(book, "nd").agg(F.sum("len").alias("_len"), F.count("*").alias("_n")).withColumn("_tot", F.sum("_len").over(Window.partitionBy(book)))


def linking_shares(needle_rows: DataFrame, held_rows: DataFrame, rule: str = "split", book: str = "doc_id", owned: DataFrame | None = None) -> DataFrame:
    """The rows of pair_share that link by a rule, without the pairs that don't.

    A book's texts are put in order of their holders, most first. As long as all of them so far wouldn't link together, a pair
    that shares no other text isn't linked: such texts make no pairs (a common line links nobody). The others meet their
    holders; what those pairs share of the common texts, of which each book has few or short ones, is added then. ``owned``: some of the rows
    of _owned, where others aren't to count."""
    spread = held_rows.groupBy("nd").agg(F.count("*").alias("_df"), F.min("other").alias("_lo"), F.max("other").alias("_hi"))
    total = Window.partitionBy(book)
    own = (_owned(needle_rows, book) if owned is None else owned).join(spread, "nd").filter((F.col("_lo") != F.col(book)) | (F.col("_hi") != F.col(book)))
    order = total.orderBy(F.desc("_df"), "nd").rowsBetween(Window.unboundedPreceding, 0)
    idle = ~_linked(F.sum("_n").over(order), F.sum("_len").over(order) / F.col("_tot"), rule)
    own = stage(own.select(F.col(book).alias("a"), "nd", "_len", "_n", "_tot", idle.alias("_idle")))
    near = own.filter("NOT _idle").join(held_rows.withColumnRenamed("other", "b"), "nd").filter("a <> b")
    near = stage(near.groupBy("a", "b", "_tot").agg(F.sum("_len").alias("_len"), F.sum("_n").alias("_n")))
    common = own.filter("_idle").select("a", "nd", F.col("_len").alias("_cl"), F.col("_n").alias("_cn"))
    also = near.select("a", "b").join(common, "a").join(held_rows.withColumnRenamed("other", "b"), ["nd", "b"], "left_semi").groupBy("a", "b").agg(F.sum("_cl").alias("_cl"), F.sum("_cn").alias("_cn"))
    both = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    rows = near.join(also, ["a", "b"], "left").select("a", "b", both("_len", "_cl").alias("chars"), both("_n", "_cn").alias("n_shared"), "_tot")
    rows = rows.select("a", "b", "chars", "n_shared", (F.col("chars") / F.col("_tot")).alias("share"))
    return rows.filter(_linked(F.col("n_shared"), F.col("share"), rule))


def connecting_links(needle_rows: DataFrame, held_rows: DataFrame, rule: str = "split", book: str = "doc_id") -> DataFrame:
    """a, b: pairs that connect the same books as the links of a rule do, without most of the links.

    A text that alone links its owner (a line that fills a tenth of a book and stands there twice) links it to every book that holds the
    text: all of those are connected, so each is paired with the least of them. All other links come from the texts that don't link alone."""
    own = stage(_owned(needle_rows, book).withColumn("_alone", _linked(F.col("_n"), F.col("_len") / F.col("_tot"), rule)))
    hubs = held_rows.join(own.filter("_alone").select("nd").distinct(), "nd", "left_semi")
    least = hubs.groupBy("nd").agg(F.min("other").alias("a"))
    stars = hubs.join(least, "nd").filter("a <> other").select("a", F.col("other").alias("b"))
    rest = linking_shares(needle_rows, held_rows, rule, book, own.filter("NOT _alone").drop("_alone"))
    return _unordered(stars.unionByName(rest.select("a", "b")))


#: Texts that link alone and that one book holds, up to which it carries them with it.
WIDE = 64


def linked_books(needle_rows: DataFrame, held_rows: DataFrame, rule: str = "split", book: str = "doc_id", ends: DataFrame | None = None) -> DataFrame:
    """a, b: link_books of linking_shares, without dealing out the pairs that a text links alone, which are the square of its holders.

    Such a text's owners meet its holders in parts, and a pair leaves that join as it is: each book carries the texts of that kind that
    it holds and those that link it, so that of several texts which link a pair the least one tells of it, and the links by several
    texts together leave it out. A book that holds more than WIDE of them carries none; its pairs are made distinct by a grouping.
    With ``ends`` (book, split), split_a and split_b too: null for books that it hasn't."""
    own = stage(_owned(needle_rows, book).withColumn("_alone", _linked(F.col("_n"), F.col("_len") / F.col("_tot"), rule)))
    linking = own.filter("_alone").select("nd", F.col(book).alias("other"), F.lit(True).alias("_l"))
    spread = held_rows.join(linking.select("nd").distinct(), "nd", "left_semi").groupBy("nd").agg(F.count("*").alias("_df")).filter("_df > 1")
    rows = stage(held_rows.join(spread, "nd").join(linking, ["nd", "other"], "left").select("nd", "other", F.coalesce("_l", F.lit(False)).alias("_l"), F.ceil(F.col("_df") / PART).cast("int").alias("_parts")))
    split = lambda df, key, name: df.withColumn(name, F.lit(None).cast("string")) if ends is None else df.join(ends.select(F.col(book).alias(key), F.col("split").alias(name)), key, "left")
    narrow = rows.groupBy("other").agg(F.count("*").alias("_m")).filter(F.col("_m") <= WIDE).select("other")
    mine = rows.join(narrow, "other", "left_semi").groupBy("other").agg(F.collect_list("nd").alias("_h"), F.collect_list(F.when(F.col("_l"), F.col("nd"))).alias("_o"))
    carried = split(rows.join(mine, "other", "left"), "other", "_s")
    side = lambda x: [F.col("other").alias(x), F.col("_l").alias(f"_l{x}"), F.col("_h").alias(f"_h{x}"), F.col("_o").alias(f"_o{x}"), F.col("_s").alias(f"split_{x}")]
    owners = carried.filter("_l").select("nd", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), *side("a"))
    holders_ = carried.select("nd", F.pmod(F.xxhash64("other"), F.col("_parts")).cast("int").alias("_part"), *side("b"))
    # owners of the text meet each other once
    pairs = owners.join(holders_, ["nd", "_part"]).filter((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~F.col("_lb")))
    told_apart = F.col("_ha").isNotNull() & F.col("_hb").isNotNull()
    common = F.array_union(F.array_intersect("_oa", "_hb"), F.array_intersect("_ob", "_ha"))
    single = (F.size("_ha") == 1) | (F.size("_hb") == 1)
    swap = F.col("a") > F.col("b")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("split_b")).otherwise(F.col("split_a")).alias("split_a"), F.when(swap, F.col("split_a")).otherwise(F.col("split_b")).alias("split_b")]
    first = pairs.filter(told_apart & F.when(single, True).otherwise(F.col("nd") == F.array_min(common))).select(*ordered)
    wide = pairs.filter(~told_apart).select(*ordered)
    # what several texts link together: not if one of them does so alone
    rest = _unordered(linking_shares(needle_rows, held_rows, rule, book, own.filter("NOT _alone").drop("_alone")))
    held_by = rows.select("other").distinct().join(mine, "other", "left").select("other", "_h", "_o", F.lit(True).alias("_is"))
    for x in ("a", "b"):
        rest = split(rest.join(held_by.select(F.col("other").alias(x), F.col("_h").alias(f"_h{x}"), F.col("_o").alias(f"_o{x}"), F.col("_is").alias(f"_is{x}")), x, "left"), x, f"split_{x}")
    both = F.col("_isa").isNotNull() & F.col("_isb").isNotNull()
    rest = rest.withColumn("_wide", both & ~told_apart).withColumn("_told", both & told_apart & (F.size(common) > 0))
    plain = rest.filter("NOT _wide AND NOT _told").select("a", "b", "split_a", "split_b")
    wide = wide.union(rest.filter("_wide").select("a", "b", "split_a", "split_b")).distinct()
    out = first.union(plain).union(wide)
    return out.select("a", "b") if ends is None else out


def boilerplate_links(shares: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Pairs that share a tenth of their text through a single needle, and aren't linked (``links``, or those of the shares)."""
    single = _unordered(shares.filter((F.col("share") >= LINK_SHARE) & (F.col("n_shared") < MIN_SHARED)))
    return single.join(link_books(shares) if links is None else links, ["a", "b"], "left_anti")


def leakage_rate(needle_rows: DataFrame, found: DataFrame, splits: DataFrame, book: str = "doc_id") -> DataFrame:
    """Per evaluation split: needles, needles found in a train book, percent."""
    train = splits.filter("split = 'train'").select(F.col(book).alias("other"))
    leaked = found.join(train, "other", "left_semi").select(book, "needle_id").distinct().withColumn("_l", F.lit(1))
    rows = needle_rows.select(book, "needle_id").join(splits.filter("split <> 'train'").select(book, "split"), book).join(leaked, [book, "needle_id"], "left")
    return rows.groupBy("split").agg(F.count("*").alias("n_long"), F.count("_l").alias("n_in_train")).withColumn("pct", F.round(F.col("n_in_train") * 100.0 / F.col("n_long"), 2))


def repeat_rate(needle_rows: DataFrame, found: DataFrame, books: DataFrame, book: str = "doc_id") -> DataFrame:
    """Per batch and in all: needles found in another book."""
    hit = found.select(book, "needle_id").distinct().withColumn("_l", F.lit(1))
    rows = needle_rows.select(book, "needle_id").join(books.select(book, "batch"), book).join(hit, [book, "needle_id"], "left")
    df = rows.rollup("batch").agg(F.count("*").alias("n_long"), F.count("_l").alias("n_repeated"))
    return df.select(F.coalesce("batch", F.lit("all")).alias("batch"), "n_long", "n_repeated", F.round(F.col("n_repeated") * 100.0 / F.col("n_long"), 1).alias("pct"))


def count_holders(strings: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id", text: str = "text") -> DataFrame:
    """nd, n: how many books' squeezed texts hold each of the distinct ``strings(nd)`` of any length; those in none are absent."""
    squeezed = books.select(book, squeeze(F.col(text), profile).alias("_t"))
    return holders(strings, squeezed, book, "_t").groupBy("nd").agg(F.count("*").alias("n"))


def leakage_by_spread(spans: DataFrame, books: DataFrame, splits: DataFrame, profile: Profile = TIBETAN, split: str = "test", short: int = 15, book: str = "doc_id") -> DataFrame:
    """Spans (book, s, e and a key) of an evaluation split, of any length, by the number of train books that hold their text
    (0, 1-2, 3-9, 10+): spans, and those of fewer than ``short`` characters."""
    own = spans.join(splits.filter(F.col("split") == split).select(book), book, "left_semi")
    own = stage(attach_text(own, books, book, context=0).select(squeeze(F.col("seg"), profile).alias("nd"), (F.col("e") - F.col("s")).alias("len")))
    train = books.join(splits.filter("split = 'train'").select(book), book, "left_semi")
    rows = own.join(count_holders(own.select("nd").distinct(), train, profile, book=book), "nd", "left")
    c = F.coalesce("n", F.lit(0))
    return rows.groupBy(F.when(c == 0, "0").when(c <= 2, "1-2").when(c <= 9, "3-9").otherwise("10+").alias("spread")).agg(F.count("*").alias("n"), F.count_if(F.col("len") < short).alias("n_short"))


def span_diversity(texts: DataFrame, profile: Profile = TIBETAN) -> DataFrame:
    """One row: spans, distinct normalised texts, singletons, spans under the 10 and the 100 commonest, the commonest."""
    counts = texts.groupBy(T.normalise_span_text(F.col("seg"), profile).alias("t")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "t").limit(100).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "t")))
    tops = top.agg(F.sum(F.when(F.col("r") <= 10, F.col("n"))).alias("top10"), F.sum("n").alias("top100"), F.max(F.when(F.col("r") == 1, F.col("t"))).alias("most_common"))
    return counts.agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_single")).crossJoin(tops)


def anchors(books: DataFrame, pattern: str | None = None, profile: Profile = TIBETAN, book: str = "doc_id", text: str = "text") -> DataFrame:
    """book, s, e of all non-overlapping matches of a heading pattern: Spark's regex functions give no offsets, so texts are
    scanned in Arrow batches."""
    import re

    import pandas as pd

    kind = books.schema[book].dataType.simpleString()

    def run(frames):
        rx = re.compile(pattern or profile.anchor)
        for f in frames:
            found = [(b, m.start(), m.end()) for b, t in zip(f["_b"], f["_t"], strict=True) if t is not None for m in rx.finditer(t)]
            yield pd.DataFrame(found, columns=[book, "s", "e"])

    return books.select(F.col(book).alias("_b"), F.col(text).alias("_t")).mapInPandas(run, f"{book} {kind}, s bigint, e bigint")


def anchor_recall(found: DataFrame, spans: DataFrame, book: str = "doc_id") -> DataFrame:
    """Per book, and in a row without book for all: headings found by pattern, those that touch a span, recall."""
    from .intervals import overlap_join

    hit = overlap_join(found.select(book, "s", "e"), spans.select(book, "s", "e"), book, how="left_semi").select(book, "s").distinct().withColumn("_h", F.lit(1))
    df = found.join(hit, [book, "s"], "left").rollup(book).agg(F.count("*").alias("n_anchors"), F.count("_h").alias("n_annotated"))
    return df.withColumn("recall", F.round(F.col("n_annotated") / F.col("n_anchors"), 6))
