"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token ids with an end mark; longer ones than a sequence are cut into pieces. What must be packed is then the
histogram of piece lengths: at most ``size`` counts, whatever the corpus. The plan is made on the histogram alone:

* Lengths fall into classes of WIDTH tokens. Patterns are all sets of up to three classes of which some lengths fill a sequence
  to the last token. Non-negative least squares (active sets) fits repeat counts of patterns to the histogram of
  classes; a basic solution has no more patterns than there are classes.
* Counts are rounded. Each pattern is realised by the exact lengths of its classes that add up to ``size``, as often as
  the histogram still has them: these sequences have no gap.
* What is left is packed best-fit: lengths in falling order, each into the sequences with the least room that holds
  it. Sequences of equal room are one group, and a length goes through whole groups at once. A group's room at least halves each
  time that it is used, so that the plan has some ten rows for each length and each run, whatever the counts.

A plan row places the pieces of one length whose ranks lie in a range. Ranks are counted in buckets of each length, so
that no task holds all pieces of a frequent length, and the plan, with its bounded number of rows, is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage_table

SIZE = 4096
#: Tokens in a class of lengths.
WIDTH = 32
#: The id after each document.
END_ID = 1
#: Pieces of one length are ranked in so many buckets at least, and in more from BUCKET_ROWS rows a bucket on.
BUCKETS, BUCKET_ROWS = 64, 1_000_000
#: Words whose ids a worker keeps; then it starts anew. A bound on memory only.
CACHE_WORDS = 600_000

# What the fast way of Encoder may see: code points below U+0180 but U+0130 and the four separators that Python, but not the
# tokenizer, takes for white space. None of them composes or changes under NFC, and each has a lower case of one code point.
_PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u017f]*")
_CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Fixed value: how the tokenizer splits normalised text. Letters and numbers are those below U+0180.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def _is_plain(text: str) -> bool:
    """Whether the fast way holds: a text with a special token's mark goes to the tokenizer."""
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


class Encoder:
    """Ids of texts by a file of the tokenizers library, without special tokens added.

    The tokenizer splits a text into words after normalising it; a word's ids don't depend on its neighbours. So words of plain
    Latin text are split here, and each is encoded once. All other text, between white space, goes to the tokenizer whole: ``encode``
    gives the tokenizer's own ids for every text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the fast way holds for this normaliser and these rules only
        self.fast = _is_known(self.tokenizer)
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x180)}
        self.words = _Words(self)

    def encode(self, text: str) -> np.ndarray:
        if not self.fast:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if _is_plain(text):
            words = _SPLIT.findall(text.lower())
        else:
            words = []
            for chunk in _CHUNK.findall(text):
                if _is_plain(chunk):
                    words += _SPLIT.findall(chunk.lower())
                else:
                    words.append(chunk)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, words)), np.uint32)


class _Words(dict):
    """The ids of words: of plain, split words by the tokenizer's model, of other text by the whole tokenizer."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> list[int]:
        own = self.encoder
        if _is_plain(word):
            ids = [t.id for t in own.tokenizer.model.tokenize(word.translate(own.letters))]
        else:
            ids = own.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that words are learned once."""
    return Encoder(path)


def _is_known(tokenizer) -> bool:
    """Whether a tokenizer has the normaliser and the rules that ``_SPLIT`` repeats."""
    import json

    rules = json.loads(tokenizer.to_str())
    steps = [s["type"] for s in (rules["normalizer"] or {}).get("normalizers", [])]
    split = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and rules["model"]["type"] == "BPE"


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, first in enumerate(range(0, len(ids), size)):
                    own = ids[first : first + size]
                    for column, value in ((at, i), (piece, k), (start, first), (length, len(own)), (crc, zlib.crc32(own.tobytes())), (kept, own)):
                        column.append(value)
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<u4"), *kept]).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs``: id_col, piece, start, length, ids_crc32 and, with ``with_ids``, ids. A document's ids end with
    END_ID, so that a null or empty text is one piece of one token; repeated rows each have their pieces; an empty table has none."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return slim.mapInArrow(_pieces(path, size, with_ids), schema).withColumnRenamed("_id", id_col)


def patterns(size: int, width: int) -> np.ndarray:
    """All patterns of up to three classes that some lengths of theirs fill to the last token: one column each, with its count
    of each class (row c: lengths above c * width up to (c + 1) * width)."""
    n = size // width
    found = [(n,)]
    # lengths fall short of their class's end by 0 to width - 1 each, and all together by whole classes
    found += [(a, b) for b in range(1, n) for over in (0, 1) for a in [n + over - b] if b <= a <= n]
    found += [(a, b, c) for c in range(1, n) for b in range(c, n) for over in (0, 1, 2) for a in [n + over - b - c] if b <= a <= n]
    out = np.zeros((n, len(found)))
    for j, classes in enumerate(found):
        for c in classes:
            out[c - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: the column of the steepest descent enters, columns that a step would turn
    negative leave. At most three steps a row: each leaves a feasible x, which fits no worse than the one before."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * len(b)):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        if slope.max() <= least:
            break
        active[slope.argmax()] = True
        while active.any():
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min()
            x[at] += step * (z - x[at])
            x[at[bad & (x[at] <= 1e-12)]] = 0
            active &= x > 0
    return x


class Plan:
    """Rows (length, first rank, pieces of a sequence, first sequence, offset): the piece of rank r at its length lies in the
    row with the greatest first rank f <= r, in sequence ``first + (r - f) // per`` at ``offset + (r - f) % per * length``."""

    def __init__(self, left: np.ndarray):
        self.left, self.rank, self.sequences = left, np.zeros(len(left), np.int64), 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def place(self, length: int, count: int, per: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.rank[length]), per, first, offset))
        self.rank[length] += count
        self.left[length] -= count

    def fill(self, lengths: tuple[int, ...], times: int) -> None:
        """New sequences that hold one piece of each of these lengths."""
        offset = 0
        for length in lengths:
            self.place(length, times, 1, self.sequences, offset)
            offset += length
        self.sequences += times

    def realise(self, classes: tuple[int, ...], times: int, size: int, width: int) -> None:
        """Sequences of this pattern, at most ``times``, of lengths that add up to ``size`` and are left."""
        for head in product(*[range(c * width, (c - 1) * width, -1) for c in classes[:-1]]):
            last = size - sum(head)
            if times and (classes[-1] - 1) * width < last <= classes[-1] * width:
                lengths = (*head, last)
                n = min(times, *[int(self.left[x]) // lengths.count(x) for x in lengths])
                if n:
                    self.fill(lengths, n)
                    times -= n

    def best_fit(self, size: int) -> None:
        """All that is left, in falling order of length: into open sequences, those with the least room first, then into new ones."""
        groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: (first sequence, count)
        has = np.zeros(size + 1, bool)

        def put(length: int, per: int, first: int, times: int, room: int) -> None:
            self.place(length, per * times, per, first, size - room)
            groups[room - per * length].append((first, times))
            has[room - per * length] = True

        for length in np.flatnonzero(self.left)[::-1].tolist():
            for room in (length + np.flatnonzero(has[length:])).tolist():
                per = room // length
                while groups[room] and self.left[length]:
                    first, count = groups[room].pop()
                    whole = min(count, int(self.left[length]) // per)
                    if whole:
                        put(length, per, first, whole, room)
                    if whole < count and self.left[length]:
                        put(length, int(self.left[length]), first + whole, 1, room)
                        whole += 1
                    if whole < count:
                        groups[room].append((first + whole, count - whole))
                has[room] = bool(groups[room])
            per = size // length
            whole, rest = divmod(int(self.left[length]), per)
            for times, n in ((whole, per), (int(rest > 0), rest)):
                if times:
                    put(length, n, self.sequences, times, size)
                    self.sequences += times

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Columns of the rows, in order of length and first rank."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(rows[:, i]) for i in range(5))


def plan(counts: np.ndarray, size: int = SIZE, width: int = WIDTH) -> Plan:
    """The plan for ``counts[length]`` pieces of each length up to ``size``."""
    found = Plan(counts.astype(np.int64))
    a = patterns(size, width)
    classes = counts[1:].reshape(-1, width).sum(axis=1).astype(float)
    x = np.rint(nnls(a, classes)).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        if x[j]:
            pattern = np.repeat(np.arange(1, len(classes) + 1), a[:, j].astype(int))
            found.realise(tuple(int(c) for c in pattern[::-1]), int(x[j]), size, width)
    found.best_fit(size)
    return found


#: Columns of a plan's rows.
PLAN = ("length", "first_rank", "per", "first_sequence", "first_offset")


def _planner(size: int, width: int):
    """Rows (length, count) of a whole histogram to the rows of its plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for b in batches:
            for length, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if length is None or not 0 < length <= size:
                    raise ValueError(f"a piece of length {length}")
                counts[length] += n
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in plan(counts, size, width).arrays()], list(PLAN))

    return run


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces(length, _row, ...)`` with ``rank``, from 0 within each length. Pieces of a length are counted in buckets by their row;
    a task sorts one bucket of one length at a time."""
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    own = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = own.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")).cast("long")
    return own.withColumn("_inside", inside).join(starts, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_inside", "_before")


def _placer(shared, at: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first_rank, per, first, offset = shared.value
        key = length * (1 << 48) + first_rank  # ranks stay below 2 ** 48
        for b in batches:
            size, rank = (b.column(i).to_numpy() for i in at)
            row = np.searchsorted(key, size * (1 << 48) + rank, side="right") - 1
            i = rank - first_rank[row]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[row] + i // per[row]), pa.array(offset[row] + i % per[row] * size)], [*b.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """``pieces`` (any rows with a length from 1 to ``size``) with sequence_id and offset. Own columns of these names are replaced;
    rows may repeat; an empty table gives no rows; a length outside that range or null is an error."""
    spark = pieces.sparkSession
    small_batches(spark)
    rows = stage_table(pieces.drop("sequence_id", "offset", "rank", "_row", "_bucket").withColumn("_row", F.monotonically_increasing_id()))
    histogram = rows.groupBy(F.col("length").cast("long").alias("length")).count()
    # at most ``size`` rows in, and a bounded plan out
    made = histogram.coalesce(1).mapInArrow(_planner(size, width), ", ".join(f"{c} bigint" for c in PLAN)).toArrow()
    shared = spark.sparkContext.broadcast(tuple(made.column(c).to_numpy() for c in PLAN))
    known = ranked(rows.withColumn("length", F.col("length").cast("long")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    placed = known.mapInArrow(_placer(shared, (known.columns.index("length"), known.columns.index("rank"))), f"{schema}, sequence_id bigint, offset bigint")
    return placed.drop("rank", "_row")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids of ``pack`` over pieces with their ``ids``. A group is one sequence."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op12_pattern_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    placed = pack(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
