"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of documents.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. The set is one sorted array
of 64-bit window hashes for each window length, built once; every hit is verified on the words themselves.
While the benchmark's texts stay under ``max_broadcast_bytes`` the set is broadcast and documents don't move;
above it, windows meet by a shuffle join on the hash, and are verified likewise, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, stage_table
from .hashing import Powers, shingles, word_hashes

WINDOW = 10
#: Above this size of all benchmark texts (bytes of UTF-8) windows are joined, not broadcast. A set takes about five times
#: its texts' size: 20 bytes for each window beside the words.
MAX_BROADCAST_BYTES = 8 << 20
#: Everything but 0-9, a-z and non-ASCII bytes becomes a space; A-Z become lower case.
_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
HITS = "n_words bigint, n_hit bigint, items array<string>, hits array<struct<start:int,end:int>>"


def split(text: bytes | None, powers: Powers) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised text, and the starts, ends and hashes of its words."""
    plain = (text or b"").translate(_TABLE)
    b = np.frombuffer(plain, np.uint8)
    return plain, *word_hashes(b, b != 32, powers)


def _gram(plain: bytes, start: np.ndarray, end: np.ndarray, i: int, size: int) -> bytes:
    """The words of a window, one space between them."""
    return b" ".join(plain[start[i] : end[i + size - 1]].split())


class Index:
    """The hash set: for each window length the sorted hashes of windows, and where each window's words lie in ``words``."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = WINDOW):
        self.items = [item for item, _ in items]
        powers, blob, at = Powers(), [], 0
        found: dict[int, list] = {}
        for item, (_, text) in enumerate(items):
            plain, start, end, h = split(text, powers)
            if not len(h):
                continue
            size = min(n, len(h))
            joined = b" ".join(plain.split())
            last = at + np.cumsum(end - start) + np.arange(len(h))  # ends of the words in the blob
            count = len(h) - size + 1
            found.setdefault(size, []).append((shingles(h, size), (last - (end - start))[:count], last[size - 1 :], np.full(count, item)))
            blob.append(joined)
            at += len(joined)
        self.words = b"".join(blob)
        self.sets = {}
        for size, parts in found.items():
            h, start, end, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.sets[size] = (h[order], start[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32))

    def scan(self, text: bytes | None, powers: Powers) -> tuple[int, set, np.ndarray | None]:
        """Number of words, items that occur, and the mask of hit words (None: no hit)."""
        plain, start, end, h = split(text, powers)
        found, hit = set(), None
        for size, (hashes, first, last, item) in self.sets.items():
            own = shingles(h, size) if len(h) >= size else h[:0]
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in np.flatnonzero(hashes[place] == own):
                gram, j = _gram(plain, start, end, i, size), place[i]
                while j < len(hashes) and hashes[j] == own[i]:
                    if self.words[first[j] : last[j]] == gram:
                        hit = np.zeros(len(h), bool) if hit is None else hit
                        hit[i : i + size] = True
                        found.add(self.items[item[j]])
                    j += 1
        return len(h), found, hit


def _runs(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _result(columns: list, names: list[str], rows: list[tuple[int, set, np.ndarray | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *columns, pa.array([n for n, _, _ in rows], pa.int64()), pa.array([0 if h is None else int(h.sum()) for *_, h in rows], pa.int64()),
            pa.array([sorted(x for x in f if x is not None) for _, f, _ in rows], pa.list_(pa.string())), pa.array([[] if h is None else _runs(h) for *_, h in rows], _RUNS),
        ],
        [*names, "n_words", "n_hit", "items", "hits"],
    )


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            yield _result([b.column(0)], ["_id"], [shared.value.scan(t, powers) for t in as_bytes(b.column(1))])

    return scan


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """(item, text) and their size in bytes."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    return items, items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]


def _shared_index(items: DataFrame, n: int):
    rows = [(r.item, r.text.encode() if r.text is not None else None) for r in items.collect()]  # at most max_broadcast_bytes
    return items.sparkSession.sparkContext.broadcast(Index(rows, n))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit (words inside a benchmark window), items (sorted ids, as
    strings, of items with a window that occurs), hits (runs of hit words, word indexes, half-open).

    Null texts have no words, items without words no windows; the windows of an item without id hit but are
    not listed; repeated items count once; repeated documents are each judged; other columns are not carried;
    an empty benchmark hits nothing.
    """
    small_batches(docs.sparkSession)
    items, size = _items(benchmark, item_col, item_text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    if size > max_broadcast_bytes:
        rows = stage_table(slim.withColumn("_row", F.monotonically_increasing_id()))
        return rows.join(_joined(rows, items, n), "_row").select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", "hits")
    return slim.mapInArrow(_scanner(_shared_index(items, n)), f"_id {kind}, {HITS}").withColumnRenamed("_id", id_col)


def _item_windows(n: int):
    """Windows of items as rows (h, size, gram, item)."""

    def run(batches):
        powers = Powers()
        for b in batches:
            out = ([], [], [], [])
            for item, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                plain, start, end, h = split(text, powers)
                size = min(n, len(h))
                for i, x in enumerate(shingles(h, size).view(np.int64).tolist() if size else ()):
                    for column, value in zip(out, (x, size, _gram(plain, start, end, i, size), item), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], ["h", "size", "gram", "item"])

    return run


def _row_windows(sizes: list[int]):
    """Windows of documents as rows (row, h, size, pos)."""

    def run(batches):
        powers = Powers()
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                h = split(text, powers)[3]
                for size in sizes:
                    if len(h) >= size:
                        own = shingles(h, size).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own), pa.array(np.full(len(own), size, np.int32)), pa.array(np.arange(len(own), dtype=np.int32))], ["_row", "h", "size", "pos"])

    return run


def _verified(batches):
    """Rows (row, text, met: structs of pos, size, gram, items) to counts and runs."""
    powers = Powers()
    for b in batches:
        rows = []
        for text, met in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            plain, start, end, h = split(text, powers)
            found, hit = set(), None
            for m in met or ():
                if _gram(plain, start, end, m["pos"], m["size"]) == m["gram"]:
                    hit = np.zeros(len(h), bool) if hit is None else hit
                    hit[m["pos"] : m["pos"] + m["size"]] = True
                    found.update(m["items"])
            rows.append((len(h), found, hit))
        yield _result([b.column(0)], ["_row"], rows)


def _joined(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The way beyond the broadcast, for rows (_row, _text): windows of both sides meet by hash, and are verified on their
    words. A passage in many documents makes many rows of one hash on the documents' side, which AQE splits."""
    grams = items.mapInArrow(_item_windows(n), "h bigint, size int, gram binary, item string").groupBy("h", "size", "gram").agg(F.collect_set("item").alias("items"))
    grams = stage_table(grams)
    sizes = [r.size for r in grams.select("size").distinct().collect()]  # at most n of them
    own = rows.select("_row", "_text").mapInArrow(_row_windows(sizes), "_row bigint, h bigint, size int, pos int")
    met = own.join(grams, ["h", "size"]).groupBy("_row").agg(F.collect_list(F.struct("pos", "size", "gram", "items")).alias("met"))
    return rows.select("_row", "_text").join(met, "_row", "left").mapInArrow(_verified, f"_row bigint, {HITS}")


def _cleaner(shared, text_at: int, spans: bool):
    def clean(batches):
        powers = Powers()
        for b in batches:
            yield _cleaned(b, [shared.value.scan(t, powers)[2] for t in as_bytes(b.column(text_at))], text_at, spans)

    return clean


def _cleaned(b: pa.RecordBatch, hit: list[np.ndarray | None], text_at: int, spans: bool) -> pa.RecordBatch:
    """Without the rows that are hit, or with ``spans`` without the hit words (and without rows that are hit as a whole)."""
    keep = pa.array([h is None or spans and not h.all() for h in hit], pa.bool_())
    columns = list(b.columns)
    if spans:
        texts = [t if h is None else without(t, h) for t, h in zip(as_bytes(b.column(text_at)), hit, strict=True)]
        columns[text_at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.schema.types[text_at])
    return pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(keep)


def _cut(text_at: int):
    """Rows with the columns of documents, then n_words and hits: without the hit words."""

    def cut(batches):
        for b in batches:
            masks = []
            for n, found in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                mask = np.zeros(n or 0, bool)
                for r in found or ():
                    mask[r["start"] : r["end"]] = True
                masks.append(mask if mask.any() else None)
            own = pa.RecordBatch.from_arrays(b.columns[:-2], schema=pa.schema(list(b.schema)[:-2]))
            yield _cleaned(own, masks, text_at, True)

    return cut


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words (and what stands between the words of a run)."""
    flat = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    out, since = [], 0
    for run in _runs(hit):
        out.append(text[since : edges[2 * run["start"]]])
        since = edges[2 * run["end"] - 1]
    return b"".join([*out, text[since:]])


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, spans: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` (all columns) without its contaminated documents, or with ``spans`` only without their hit passages
    (a document of which nothing is left goes). Documents don't move; with a benchmark above the bound they are joined with
    their hits. Nulls and repeats as in ``hits``."""
    small_batches(docs.sparkSession)
    items, size = _items(benchmark, item_col, item_text_col)
    at = docs.columns.index(text_col)
    if size <= max_broadcast_bytes:
        return docs.mapInArrow(_cleaner(_shared_index(items, n), at, spans), docs.schema)
    rows = stage_table(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = _joined(rows.select(F.col("__row").alias("_row"), F.col(text_col).alias("_text")), items, n).filter("n_hit > 0")
    found = found.select(F.col("_row").alias("__row"), F.col("n_words").alias("__n"), F.col("hits").alias("__hits"))
    if not spans:
        return rows.join(found, "__row", "left_anti").select(*docs.columns)
    return rows.join(found, "__row", "left").select(*docs.columns, "__n", "__hits").mapInArrow(_cut(at), docs.schema)


def digest_ids(items: set | list) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op8_benchmark_decontamination(spark, sf_dir):
    from .common import table

    df = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: translate() lower-cases A-Z only.
_WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS_SQL.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
       FROM (SELECT rid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
