"""Phrase collocation mining by vertical partitioning of a truncated suffix tree.

All words of a piece are suffixes of it, truncated to DEPTH words: the leaves of a suffix tree over words, whose nodes
are the phrases and whose totals are their counts. The tree is never built as a whole:

1. Prefixes of one word are counted. One that more suffixes have than the memory budget of a group allows is heavy, and is
   extended by its next word; a prefix of two heavy words by a third one, as only such pairs can be heavy themselves.
2. The prefixes, in the order of their hashes, are cut into groups that fill the budget: by the counts of light ones, and by an equal
   share of the suffixes of heavy ones, which their extensions spread over all hashes. The cuts (8 bytes a group) are broadcast.
3. Every suffix goes to the group of its prefix, equal ones of a task as one row with its count; a pair of heavy words sends
   its count along for itself. Suffixes end before a word that is rarer than a candidate may be, as far as a bitmap of frequent
   words of fixed size tells; a word that it lets pass in error costs a row and changes nothing.
4. Each group sorts its suffixes, which is its part of the tree, and reads the counts of its nodes from totals of leaves.
   The parts of a phrase's cuts lie in any group; they are joined.

Words of different languages are different words: the language is a symbol of each suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, stage_table
from .hashing import mix

#: Longest phrase.
DEPTH = 3
MIN_COUNT = 10
TOP = 2000
#: A phrase goes if a longer candidate around it has at least this share of its count, in percent.
COVERED_PERCENT = 50
#: Suffixes of a group, and most groups there may be; beyond these the budget grows.
GROUP_SUFFIXES, MAX_GROUPS = 250_000, 2_000_000
#: Ranges of hashes that are cut into groups side by side.
RANGES = 64
#: Bits of the map of frequent words: 8 MB.
BITMAP_BITS = 1 << 26
#: Bytes of text that a task looks at together, and words that it keeps. Bounds on memory only.
CHUNK_BYTES, KEPT_WORDS = 4 << 20, 1 << 20
END = b"\xff"  # no byte of UTF-8
#: A-Z to a-z, ends of pieces to END, tab to space.
_TABLE = bytes(b + 32 if 65 <= b < 91 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_LAST = 1 << 21  # codes of words are below it, so that three of them fit a long


class Words(dict):
    """Codes of the words of one language, and their hashes, in the order they come. Code 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.key = hashlib.blake2b(lang.encode(), digest_size=32).digest()
        self.names, self.hashes = [END], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.names)
        self.names.append(word)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little", signed=True))
        return code

    def codes(self, text: bytes) -> np.ndarray:
        words = text.replace(END, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hash_array(self) -> np.ndarray:
        return np.array(self.hashes, np.int64)


def _extend(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that are one word longer."""
    return mix(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + following.view(np.uint64)).view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts with their piece ends as END, in parts of about CHUNK_BYTES that end with a piece."""
    pending, size = [], 0
    for text in texts:
        text, at = text.translate(_TABLE), 0
        while len(text) - at > CHUNK_BYTES:
            cut = text.find(END, at + CHUNK_BYTES)
            if cut < 0:
                break
            yield text[at : cut + 1]
            at = cut + 1
        pending.append(text[at:] if at else text)
        size += len(pending[-1])
        if size > CHUNK_BYTES:
            yield END.join(pending)
            pending, size = [], 0
    if pending:
        yield END.join(pending)


def _by_language(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Gives chunks (words of the language, lang, text) to ``use``, which yields batches; batches hold (lang, text)."""
    vocabulary: dict[str, Words] = {}
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for chunk in _chunks(own):
                words = vocabulary.get(lang)
                if words is None or len(words.names) > KEPT_WORDS:
                    words = vocabulary[lang] = Words(lang)
                yield from use(words, lang, chunk)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _word_counts(batches):
    """(lang, word, h, n) of the words of a task's chunks."""

    def use(words, lang, chunk):
        counts = np.bincount(words.codes(chunk), minlength=1)
        counts[0] = 0
        at = np.flatnonzero(counts)
        names = _strings([words.names[i] for i in at])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), names, pa.array(words.hash_array()[at]), pa.array(counts[at])], ["lang", "word", "h", "n"])

    yield from _by_language(batches, use)


class Partition:
    """What a task needs to send a suffix to its group: the cuts between groups, the heavy words of each language, and the bitmap of
    frequent words."""

    def __init__(self, cuts: np.ndarray, heavy: dict[str, list[bytes]], bitmap: np.ndarray):
        self.cuts, self.heavy, self.bitmap = cuts, heavy, bitmap

    def frequent(self, h: np.ndarray) -> np.ndarray:
        bit = h & (BITMAP_BITS - 1)
        return (self.bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _suffixes(shared):
    """(group, leaf, n) of the truncated suffixes of two words or more. A leaf is its three words and the language, parted by tabs;
    the third word is empty where the suffix ends. n is negative where the group holds only a part of the pair's suffixes."""

    def run(batches):
        part = shared.value

        def use(words, lang, chunk):
            code = words.codes(chunk)
            h = words.hash_array()
            known = part.frequent(h)
            known[0] = False
            code[~known[code]] = 0
            three = np.concatenate((code, [0, 0]))
            first, second, third = three[:-2], three[1:-1], three[2:]
            at = np.flatnonzero((first > 0) & (second > 0))
            leaves, n = np.unique((first[at] * _LAST + second[at]) * _LAST + third[at], return_counts=True)
            first, second, third = leaves // (_LAST * _LAST), leaves // _LAST % _LAST, leaves % _LAST
            is_heavy = np.zeros(len(h), bool)
            is_heavy[[words[w] for w in part.heavy.get(lang, ()) if w in words]] = True
            both = is_heavy[first] & is_heavy[second]
            # the counts of pairs of two heavy words, and then their suffixes of three words on their own
            pairs, pair_at = np.unique(leaves[both] // _LAST, return_inverse=True)
            pair_n = np.bincount(pair_at, weights=n[both], minlength=len(pairs)).astype(np.int64)
            keep = np.flatnonzero(~both | (third > 0))
            first, second, third, n, both = first[keep], second[keep], third[keep], n[keep], both[keep]
            prefix = h[first]
            prefix = np.where(is_heavy[first], _extend(prefix, h[second]), prefix)
            prefix = np.where(both, _extend(prefix, h[third]), prefix)
            first, second, third = (np.concatenate(x) for x in ((first, pairs // _LAST), (second, pairs % _LAST), (third, np.zeros(len(pairs), np.int64))))
            prefix = np.concatenate((prefix, _extend(h[pairs // _LAST], h[pairs % _LAST])))
            n = np.concatenate((np.where(both, -n, n), pair_n))
            group = np.searchsorted(part.cuts, prefix, side="right").astype(np.int32)
            names = _strings([b"", *words.names[1:]])
            for i in range(0, len(n), 50_000):
                columns = [names.take(pa.array(x[i : i + 50_000])) for x in (first, second, third)]
                yield pa.RecordBatch.from_arrays([pa.array(group[i : i + 50_000]), pc.binary_join_element_wise(*columns, lang, "\t"), pa.array(n[i : i + 50_000])], ["group", "leaf", "n"])

        yield from _by_language(batches, use)

    return run


NODES = "lang string, w1 string, w2 string, w3 string, f bigint"


def _subtree(least: int):
    """A group's suffixes to its nodes of two and three words that occur ``least`` times: NODES, w3 empty for pairs."""

    def run(leaves: pa.Table) -> pa.Table:
        parts = pc.split_pattern(leaves.column("leaf").combine_chunks(), "\t", max_splits=DEPTH)
        symbols = parts.flatten().dictionary_encode()
        w1, w2, w3, lang = symbols.indices.to_numpy().reshape(-1, DEPTH + 1).T
        order = np.lexsort((w3, w2, w1, lang))
        w1, w2, w3, lang = w1[order], w2[order], w3[order], lang[order]
        n = leaves.column("n").to_numpy()[order]
        new, out = np.ones(len(n), bool), []
        new[1:] = (lang[1:] != lang[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        names = pa.concat_arrays([symbols.dictionary, pa.array([""])])
        end = pc.index(names, "").as_py()
        # a pair's suffixes, or what was sent along for it; then those of three words
        for third, count in ((np.full(len(n), end), n.clip(0)), (w3, np.abs(n))):
            new[1:] |= third[1:] != third[:-1]
            start = np.flatnonzero(new)
            f = np.add.reduceat(count, start)
            keep = f >= least if third is not w3 else (f >= least) & (third[start] != end)
            at = start[keep]
            out.append(pa.table([*[names.take(pa.array(x[at])) for x in (lang, w1, w2, third)], pa.array(f[keep])], ["lang", "w1", "w2", "w3", "f"]))
        return pa.concat_tables(out)

    return run


def _bitmap(words: DataFrame) -> np.ndarray:
    """The bits of the hashes of ``words(h)``: at most BITMAP_BITS of them come to the driver."""
    bit = F.col("h").bitwiseAND(BITMAP_BITS - 1) + 1
    rows = words.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    return out


def _cuts(prefixes: DataFrame, spread: int, budget: int) -> np.ndarray:
    """Least hashes of the groups that ``prefixes(h, n)`` and ``spread`` suffixes of any hash fill, in order: a group is closed once it
    holds ``budget`` suffixes."""
    ordered = Window.partitionBy("range").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    points = max(4, spread // budget)
    even = prefixes.sparkSession.range(points).select(((F.col("id") - points // 2) * ((1 << 64) // points)).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("n"))
    inside = F.col("h").cast("double") / 2.0**64 * spread
    filled = prefixes.unionByName(even).withColumn("range", F.floor(F.col("h").cast("double") / 2.0**64 * RANGES)).withColumn("place", F.floor((F.coalesce(F.sum("n").over(ordered), F.lit(0)) + inside) / budget))
    rows = filled.groupBy("range", "place").agg(F.min("h").alias("h")).select("h").toArrow()  # at most MAX_GROUPS and a few
    return np.sort(rows.column("h").to_numpy())


def vertical_partition(words: DataFrame, least: int, group_suffixes: int) -> Partition:
    """The groups for the counted ``words(lang, word, h, n)``."""
    frequent = words.filter(F.col("n") >= least)
    budget = max(group_suffixes, (frequent.agg(F.sum("n")).first()[0] or 0) // MAX_GROUPS)
    heavy: dict[str, list[bytes]] = {}
    spread = 0
    for r in frequent.filter(F.col("n") > budget).collect():  # fewer than MAX_GROUPS
        heavy.setdefault(r["lang"], []).append(r["word"].encode())
        spread += r["n"]
    return Partition(_cuts(frequent.filter(F.col("n") <= budget).select("h", "n"), spread, budget), heavy, _bitmap(frequent))


def phrase_nodes(texts: DataFrame, words: DataFrame, least: int = MIN_COUNT, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """NODES of the truncated suffix tree that occur ``least`` times: w2 is empty for words, w3 for words and pairs."""
    shared = texts.sparkSession.sparkContext.broadcast(vertical_partition(words, least, group_suffixes))
    leaves = texts.mapInArrow(_suffixes(shared), "`group` int, leaf string, n bigint")
    nodes = leaves.groupBy("group").applyInArrow(_subtree(least), NODES)
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("w1"), F.lit("").alias("w2"), F.lit("").alias("w3"), F.col("n").alias("f"))
    return stage_table(nodes.unionByName(single))


def _exact_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in decimals of up to 38 digits: counts stay below 10 ** 15."""
    a, l, r = (c.cast("decimal(15,0)") for c in (a, l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r)


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a (its count), l, r (counts of the parts of its worst cut), n (words
    of the language), score.

    Null languages are ``und``, null texts empty; repeated rows count each; other columns aren't read; an empty table, or one without a
    phrase that occurs ``least`` times, gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stage_table(texts.mapInArrow(_word_counts, "lang string, word string, h bigint, n bigint").groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n")))
    nodes = phrase_nodes(texts, words, least, group_suffixes)
    # the two parts of each cut: the first k words and the rest
    def at(k: int, *words) -> Column:
        return F.struct(F.lit(k).alias("k"), *[(F.col(w) if w else F.lit("")).alias(x) for w, x in zip(words, ("a1", "a2", "b1", "b2"), strict=True)])

    cuts = F.array(at(1, "w1", "", "w2", "w3"), F.when(F.col("w3") != "", at(2, "w1", "w2", "w3", "")))
    cut = nodes.filter("w2 <> ''").select("lang", "w1", "w2", "w3", F.col("f").alias("a"), F.inline(F.array_compact(cuts)))
    short = nodes.filter("w3 = ''")
    part = lambda x, f: short.select("lang", F.col("w1").alias(f"{x}1"), F.col("w2").alias(f"{x}2"), F.col("f").alias(f))
    scored = cut.join(part("a", "l"), ["lang", "a1", "a2"]).join(part("b", "r"), ["lang", "b1", "b2"]).withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
    worst = scored.groupBy("lang", "w1", "w2", "w3").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    candidates = stage_table(worst.select("lang", "w1", "w2", "w3", "a", "c.l", "c.r", "c.score"))
    inside = F.explode(F.array(F.struct(F.col("w1"), F.col("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longer = candidates.filter("w3 <> ''").select("lang", "a", inside.alias("p")).groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg((F.max("a") * 100).alias("longest"))
    longer = longer.withColumn("w3", F.lit(""))
    kept = candidates.join(longer, ["lang", "w1", "w2", "w3"], "left").filter(F.col("longest").isNull() | (F.col("longest") < COVERED_PERCENT * F.col("a")))
    phrase = F.concat_ws(" ", "w1", "w2", F.when(F.col("w3") != "", F.col("w3")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark, sf_dir):
    from .common import table

    return mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)),
x AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
o AS (SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3 FROM x),
f1 AS (SELECT lang, a1 AS phrase, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, a1, a2, a1 || ' ' || a2 AS phrase, count(*) AS f FROM o WHERE a2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a1, a2, a3, a1 || ' ' || a2 || ' ' || a3 AS phrase, count(*) AS f FROM o WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2),
cut AS (SELECT lang, phrase, f, 1 AS k, a1 AS p1, a2 AS p2, 2 AS words FROM f2 WHERE f >= 10
  UNION ALL SELECT lang, phrase, f, 1, a1, a2 || ' ' || a3, 3 FROM f3 UNION ALL SELECT lang, phrase, f, 2, a1 || ' ' || a2, a3, 3 FROM f3),
s AS (SELECT cut.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * cut.f * cut.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = p1 JOIN f r ON r.lang = cut.lang AND r.phrase = p2),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a1 || ' ' || a2 AS phrase, f FROM f3 UNION ALL SELECT lang, a2 || ' ' || a3, f FROM f3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE words = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * c.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, ranked.f AS a, l, r, (SELECT sum(f1.f) FROM f1 WHERE f1.lang = ranked.lang)::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""
