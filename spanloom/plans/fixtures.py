"""Span tables derived from ``documents`` and ``labels``, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import bounded_batches

SEG = r"[^.\n]*[.\n]|[^.\n]+"
TOK = r"[^ \n]+[ \n]*|[ \n]+"
LEAST = 15
#: Pieces that leave a task together; a text with more of them goes alone.
PIECES = 1 << 16


def _pieces_of(pattern: str):
    """Batches of (text, other columns) to a row for each match in each text: the other columns, i, p (the match), s0 (where it starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern)
        for b in batches:
            found, rows, n = [], [], 0
            for row, text in enumerate(b.column(0).to_pylist()):
                found.append(rx.findall(text) if text is not None else [])
                rows.append(row)
                n += len(found[-1])
                if n >= PIECES or row + 1 == b.num_rows:
                    size = np.array([len(x) for x in found])
                    flat = [p for x in found for p in x]
                    length = np.fromiter(map(len, flat), np.int64, n)
                    first = np.cumsum(size) - size
                    total = np.concatenate(([0], np.cumsum(length)))
                    at = pa.array(np.repeat(rows, size))
                    columns = [np.arange(n) - np.repeat(first, size), pa.array(flat, pa.string()), total[:-1] - np.repeat(total[first], size)]
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(1, b.num_columns)], *[pa.array(c) for c in columns]], [*b.schema.names[1:], "i", "p", "s0"])
                    found, rows, n = [], [], 0

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, other columns) to a row for each match of SEG that is LEAST long without spaces before it and stops, spaces and line
    breaks after it: the other columns, seg_idx, s, e. Only places leave the task, not the matches."""
    for b in batches:
        rows, columns = [], ([], [], [])
        for row, text in enumerate(b.column(0).to_pylist()):
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            space, ends = codes == ord(" "), (codes == ord(".")) | (codes == ord("\n"))
            stop = np.flatnonzero(ends) + 1
            if len(codes) and not ends[-1]:
                stop = np.append(stop, len(codes))
            start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
            # the first place from the start that is no space, and the one after the last that is kept
            filled, kept = np.append(np.flatnonzero(~space), len(codes)), np.concatenate(([0], np.flatnonzero(~(ends | space)) + 1))
            s = np.minimum(filled[np.searchsorted(filled, start)], stop)
            e = np.maximum(kept[np.searchsorted(kept, stop, side="right") - 1], start)
            long = np.flatnonzero(e - s >= LEAST)
            rows.append(np.full(len(long), row))
            for column, value in zip(columns, (long, s[long], e[long]), strict=True):
                column.append(value)
        flat = [np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in (rows, *columns)]
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(flat[0])) for k in range(1, b.num_columns)], *[pa.array(c) for c in flat[1:]]], [*b.schema.names[1:], "seg_idx", "s", "e"])


class Tables:
    """The derived tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.read("documents")

    def books(self, *more: str) -> DataFrame:
        batch = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 10, "old").otherwise("new")
        return self.documents().select("doc_id", batch.alias("batch"), "n_chars", *more)

    def texts(self) -> DataFrame:
        return self.documents().select("doc_id", "text")

    def dealt(self, docs: DataFrame) -> DataFrame:
        """Texts, dealt out by book where few files hold them: else few tasks would read all of them."""
        return docs.repartition("doc_id") if len(docs.inputFiles()) < self.spark.sparkContext.defaultParallelism else docs

    def _in_rows(self, run, kinds: str) -> DataFrame:
        """What an Arrow function makes of the texts, with doc_id, source and n_chars: within the row, so that nothing of it is shuffled."""
        bounded_batches(self.spark)
        docs = self.dealt(self.documents().select("text", "doc_id", "source", "n_chars"))
        return docs.mapInArrow(run, ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in docs.columns[1:]], kinds]))

    def _pieces(self, pattern: str) -> DataFrame:
        """The matches of a pattern that tiles the texts, and where they start."""
        return self._in_rows(_pieces_of(pattern), "i bigint, p string, s0 bigint")

    def seg(self) -> DataFrame:
        return self._in_rows(_segments, "seg_idx bigint, s bigint, e bigint")

    def gold(self) -> DataFrame:
        return self.seg().filter("(doc_id * 31 + seg_idx * 7) % 4 = 0").select("doc_id", "seg_idx", "s", "e", "n_chars")

    def pred(self) -> DataFrame:
        """With ``pred_ix``, the place in file order."""
        seg = self.seg()
        gold = seg.filter("(doc_id * 31 + seg_idx * 7) % 4 = 0")
        moved = gold.filter("(doc_id + seg_idx) % 11 <> 0").selectExpr("doc_id", "s + (seg_idx % 3) * 2 AS s", "e - (doc_id % 4) * 3 AS e", "1 AS kind")
        false = seg.filter("(doc_id * 31 + seg_idx * 7) % 4 = 1 AND (doc_id + seg_idx) % 9 = 0").selectExpr("doc_id", "s", "e", "2 AS kind")
        twice = gold.filter("(doc_id + seg_idx) % 13 = 0").selectExpr("doc_id", "s", "s + ((e - s) * 2) div 3 AS e", "3 AS kind")
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "e", "kind")) - 1
        return moved.union(false).union(twice).withColumn("pred_ix", rank.cast("long")).drop("kind")

    def raw(self) -> DataFrame:
        d = F.expr("CASE WHEN doc_id % 10 = 0 AND seg_idx < 20 THEN 12 WHEN doc_id % 10 = 0 THEN 17 WHEN (doc_id + seg_idx) % 5 = 0 THEN 1 ELSE 0 END")
        return self.gold().withColumn("d", d).filter("e + d <= n_chars").selectExpr("doc_id", "seg_idx", "s + d AS s", "e + d AS e", "n_chars")

    def other(self) -> DataFrame:
        seg = self.seg()
        quote = seg.filter("(doc_id * 31 + seg_idx * 7) % 4 = 2").selectExpr("doc_id", "'quote' AS layer", "seg_idx", "s", "e")
        chapter = seg.filter("(doc_id * 31 + seg_idx * 7) % 4 = 0 AND (doc_id + seg_idx) % 19 = 0 AND e + 5 <= n_chars").selectExpr("doc_id", "'chapter' AS layer", "seg_idx", "s + 5 AS s", "e + 5 AS e")
        return quote.union(chapter)

    def prior(self) -> DataFrame:
        return self.read("labels").selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split", "doc_id - doc_id % 3 AS group_id").distinct()

    def token_counts(self) -> DataFrame:
        """doc_id, n: the tokens of each text that has any."""
        return self.documents().select("doc_id", F.size(F.regexp_extract_all("text", F.lit(TOK), F.lit(0))).cast("long").alias("n")).filter("n > 0")

    def tok(self) -> DataFrame:
        df = self._pieces(TOK)
        return df.select("doc_id", F.col("i").alias("tok_ix"), F.col("s0").alias("s"), (F.col("s0") + F.length(F.rtrim("p", F.lit(" \n")))).alias("e"), F.col("p").alias("piece"))


# The same tables for DuckDB.
CTES = {
    "pieces": r"""pieces AS (SELECT doc_id, source, n_chars, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS p
        FROM (SELECT *, regexp_extract_all(text, '[^.\n]*[.\n]|[^.\n]+') AS p FROM documents))""",
    "seg": r"""seg AS (SELECT * FROM (SELECT doc_id, source, n_chars, i AS seg_idx, (s0 + length(p) - length(ltrim(p, ' ')))::BIGINT AS s, (s0 + length(rtrim(p, E'. \n')))::BIGINT AS e
        FROM (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM pieces)) WHERE e - s >= 15)""",
    "gold": "gold AS (SELECT doc_id, seg_idx, s, e, n_chars FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 0)",
    "pred": """pred AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, kind) - 1 AS pred_ix FROM (
        SELECT doc_id, s + (seg_idx % 3) * 2 AS s, e - (doc_id % 4) * 3 AS e, 1 AS kind FROM gold WHERE (doc_id + seg_idx) % 11 <> 0
        UNION ALL SELECT doc_id, s, e, 2 FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 1 AND (doc_id + seg_idx) % 9 = 0
        UNION ALL SELECT doc_id, s, s + ((e - s) * 2) // 3, 3 FROM gold WHERE (doc_id + seg_idx) % 13 = 0))""",
    "raw": """raw AS (SELECT doc_id, seg_idx, s + d AS s, e + d AS e, n_chars FROM (SELECT *, CASE WHEN doc_id % 10 = 0 AND seg_idx < 20 THEN 12 WHEN doc_id % 10 = 0 THEN 17
        WHEN (doc_id + seg_idx) % 5 = 0 THEN 1 ELSE 0 END AS d FROM gold) WHERE e + d <= n_chars)""",
    "other": """other AS (SELECT doc_id, 'quote' AS layer, seg_idx, s, e FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 2
        UNION ALL SELECT doc_id, 'chapter', seg_idx, s + 5, e + 5 FROM gold WHERE (doc_id + seg_idx) % 19 = 0 AND e + 5 <= n_chars)""",
    "books": "books AS (SELECT doc_id, CASE WHEN try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT) < 10 THEN 'old' ELSE 'new' END AS batch, n_chars FROM documents)",
    "prior": "prior AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, doc_id - doc_id % 3 AS group_id FROM labels)",
    "tok": r"""tok AS (SELECT doc_id, i AS tok_ix, s0::BIGINT AS s, (s0 + length(rtrim(p, E' \n')))::BIGINT AS e, p AS piece FROM (
        SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM (
        SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS p FROM (SELECT *, regexp_extract_all(text, '[^ \n]+[ \n]*|[ \n]+') AS p FROM documents))))""",
}
NEEDS = {"seg": ("pieces",), "gold": ("seg",), "pred": ("gold",), "raw": ("gold",), "other": ("gold",)}


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` (further CTEs and the query, or the query alone) after the CTEs of ``tables`` and of what they need.
    A body that starts with WITH goes on with its own CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    head = ",\n".join(CTES[t] for t in order)
    body = body.strip()
    rest = (",\n" if head else "") + body[5:] if body[:5].upper() == "WITH " else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"


def collector(queries: dict, oracles: dict):
    """A decorator that registers a function of Tables as a query, with its DuckDB twin if there is one."""

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle is not None:
                oracles[f.__name__] = oracle
            return f

        return add

    return query
