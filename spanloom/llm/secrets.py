"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a Parquet table,
holds the findings of each pair of blob and rule version that was ever scanned (also of those
without findings). A scan takes only the pairs that the ledger lacks, appends their findings, and
joins the findings of all blobs back to every path (document) that holds them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

#: Fixed base rules: kind, pattern, group whose length counts, least length.
BASE_RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Further rules: key blocks and tokens with a published prefix.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES
#: Made from the rules: ledger rows of other rules no longer count.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
#: Findings of so many bytes (48 for a blob, 12 for a finding) are broadcast to the texts that hold them.
MAX_BROADCAST_BYTES = 16 << 20
KINDS = [r[0] for r in RULES]
FINDINGS = "array<struct<start:int,end:int,kind:int>>"
_FIND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))


def compiled(rules=RULES):
    out = []
    for kind, (_, pattern, group, least) in enumerate(rules):
        if pattern == r"[0-9a-f]+":  # a run is maximal anyway: let the engine skip the short ones
            pattern = r"[0-9a-f]{%d,}" % least
        out.append((kind, re.compile(pattern), group, least))
    return out


def find(text: str | None, rules) -> list[dict]:
    """Findings of one text, by start, then kind; code points, half-open. Null and empty texts have none."""
    found = []
    for kind, pattern, group, least in rules:
        for m in pattern.finditer(text or ""):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    found.sort()
    return [{"start": s, "end": e, "kind": k} for s, k, e in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = compiled()
    for b in batches:
        found = [find(t, rules) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FIND_TYPE)], ["blob", "findings"])


def blob_key(text: Column) -> Column:
    """The address of a version: the SHA-256 of its content, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan_with_ledger(docs: DataFrame, ledger_path: str, text_col: str = "text") -> DataFrame:
    """Scans what the ledger at ``ledger_path`` lacks, adds it there, and returns the ledger's rows (blob,
    rule_version, findings) of the current rule version. A null text is the empty blob."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # copies meet before the shuffle first, so that a much-copied blob is a few rows
    blobs = docs.select(blob_key(text).alias("blob"), text.alias("body")).dropDuplicates(["blob"])
    schema = f"blob binary, rule_version string, findings {FINDINGS}"
    if exists(spark, ledger_path):
        known = spark.read.schema(schema).parquet(ledger_path).filter(F.col("rule_version") == RULE_VERSION)
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    fresh = blobs.mapInArrow(_scan, f"blob binary, findings {FINDINGS}")
    fresh.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    return spark.read.schema(schema).parquet(ledger_path).filter(F.col("rule_version") == RULE_VERSION)


def findings(docs: DataFrame, ledger_path: str | None = None, text_col: str = "text", out_col: str = "findings") -> DataFrame:
    """``docs`` (all columns) with ``findings``: the spans of secrets of its text, by start, then kind.

    Without ``ledger_path`` a new ledger is made in the shared folder. Null and empty texts get an empty
    array; repeated texts and rows each keep their row; an own column named out_col is replaced.
    """
    ledger = scan_with_ledger(docs, ledger_path or shared_dir(docs.sparkSession), text_col)
    hits = ledger.filter(F.size("findings") > 0).select(F.col("blob").alias("__blob"), F.col("findings").alias("__found")).dropDuplicates(["__blob"])
    blob = blob_key(F.coalesce(F.col(text_col), F.lit("")))
    size = hits.agg(F.coalesce(F.sum(48 + 12 * F.size("__found")), F.lit(0))).first()[0]
    # a blob in very many rows makes no hot task either way: AQE splits the texts' side of the shuffle
    hits = F.broadcast(hits) if size <= MAX_BROADCAST_BYTES else hits
    joined = docs.drop(out_col).withColumn("__key", blob).join(hits, F.col("__key") == F.col("__blob"), "left")
    return joined.withColumn(out_col, F.coalesce("__found", F.array().cast(FINDINGS))).drop("__key", "__blob", "__found")


def redact(docs: DataFrame, ledger_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``[kind]``; overlapping findings become one."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.col(text_col)

    def step(acc, x):
        # what lies between the last finding and this one, then the mark
        piece = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), F.element_at(kinds, x["kind"] + 1), F.lit("]"))).otherwise(acc["out"])
        return F.struct(piece.alias("out"), F.greatest(acc["pos"], x["end"]).alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    out = findings(docs, ledger_path, text_col, "__spans")
    return out.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(text)).drop("__spans")


def spans_string(found, kinds: int):
    """``kind:start:end`` of the findings of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    keep = F.filter(found, lambda x: x["kind"] < kinds)
    return F.array_join(F.transform(keep, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Counts and digest for each document. The texts don't travel with the join: only ids and blob keys do."""
    ledger = scan_with_ledger(docs, ledger_path or shared_dir(docs.sparkSession))
    hits = ledger.filter(F.size("findings") > 0).select(F.col("blob").alias("_blob"), F.col("findings").alias("_found")).dropDuplicates(["_blob"])
    paths = docs.select("doc_id", blob_key(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))
    found = F.coalesce("_found", F.array().cast(FINDINGS))
    df = paths.join(hits, F.col("_key") == F.col("_blob"), "left").select("doc_id", found.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_string(F.col("found"), len(BASE_RULES)).cast("binary"), 256).alias("base_sha256"),
        spans_string(F.col("found"), len(RULES)).alias("spans"),
    )


def op6_secret_ledger(spark, sf_dir):
    from .common import table

    return digest(table(spark, sf_dir, "documents"))


def _found_sql(kind: int) -> str:
    """(rid, k, s, e) of a kind: matches are marked, and the pieces between the marks give the places."""
    _, pattern, group, least = RULES[kind]
    pattern = pattern.replace("(?ai:", "(?i:").replace("'", "''")
    long_enough = f"regexp_extract(m, '{pattern}', {group})" if group else "m"
    return f"""SELECT rid, {kind} AS k, s, s + len(m) AS e FROM (
 SELECT rid, i, m, (sum(n) OVER (PARTITION BY rid ORDER BY i) - n)::BIGINT AS s FROM (
  SELECT rid, i, split_part(x, chr(2), 1) AS m, len(x) - CASE WHEN i > 1 THEN 1 ELSE 0 END AS n FROM (
   SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (
    SELECT rid, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS x FROM d WHERE regexp_matches(t, '{pattern}'))))) WHERE i > 1 AND len({long_enough}) >= {least}"""


_NAMES_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
OP6_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, {_NAMES_SQL}[k + 1] || ':' || s || ':' || e AS x FROM ({" UNION ALL ".join(_found_sql(i) for i in range(len(RULES)))})),
g AS (SELECT rid, count_if(k = 0)::BIGINT AS n0, count_if(k = 1)::BIGINT AS n1, count_if(k = 2)::BIGINT AS n2,
             string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE_RULES)}) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""
