"""WARC archives, written and read with Spark's own text source.

Writing: one record per page; among equal payloads the first page holds the payload (response), later
ones refer to it (revisit). Reading: a file is cut at every occurrence of the record magic, also at those
inside payloads. Each cut gives a candidate record and the offset of its successor, from its header's
length. Pointer jumping from the start of each file keeps the candidates that the chain reaches; magic
inside payloads is never reached, and the pieces around it are joined again. Whatever the file system, all
access is by Spark's readers and writers, and files are read in splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage_table

MAGIC = "WARC/1.0\r\n"
#: Smaller payloads are always responses.
MIN_REVISIT_BYTES = 100
#: Records of one file at most; bounds the rounds of pointer jumping.
RECORDS_PER_FILE = 50_000
#: So many digests (32 bytes and an id each) that occur more than once are broadcast to the pages; more are joined by a
#: shuffle.
MAX_BROADCAST_DIGESTS = 200_000


def classify(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with payload (null html: empty), payload_bytes, payload_digest, record_type and refers_to.

    Only digests that occur twice or more are joined back, so that pages stay in place while these are few. A null id
    is never referred to unless a payload has no other. Of rows with one id and payload none revisits another."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    df = pages.withColumn("payload", text).withColumn("payload_bytes", F.octet_length(text).cast("long")).withColumn("payload_digest", F.sha2(text.cast("binary"), 256))
    big = df.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    shared = big.groupBy("payload_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    shared = stage_table(shared.select(F.unhex("payload_digest").alias("_digest"), "_first"))
    shared = F.broadcast(shared) if shared.count() <= MAX_BROADCAST_DIGESTS else shared.hint("merge")
    df = df.join(shared, F.unhex("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first"))
    return df.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_digest", "_first")


def _line(name: str, value: Column) -> Column:
    # no line break inside a header field
    safe = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per page below ``path``. A record's id and date-free fields are plain headers; a null id or
    url leaves its field out; revisits carry headers only, with the full payload's length and digest."""
    df = classify(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "page_id", "html")
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.url_encode(F.col("page_id").cast("string")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.url_encode(F.col("refers_to").cast("string")), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )
    # the writer's line separator is the second half of the record's closing blank line
    df.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the files between magics: file, block (start of the split), seq (order in the split), value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _header(df: DataFrame) -> DataFrame:
    """head_bytes (with the blank line) and the fields of each piece; head_bytes null where there is no header."""
    end = F.instr("value", "\r\n\r\n")
    df = df.withColumn("_head", F.when(end > 0, F.substring("value", F.lit(1), end + 3)))
    field = lambda n, r: F.nullif(F.regexp_extract("_head", rf"(?:^|\n){n}: {r}\r", 1), F.lit(""))
    return df.select(
        "*",
        F.octet_length("_head").alias("head_bytes"),
        F.try_to_number(field("Content-Length", "([0-9]{1,18})"), F.lit("9" * 18)).cast("long").alias("body_bytes"),
        field("WARC-Type", "(\\S+)").alias("record_type"),
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("page"),
        field("WARC-Target-URI", "([^\r]*)").alias("url"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("named_digest"),
        field("WARC-Payload-Length", "([0-9]+)").cast("long").alias("named_bytes"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece, without its bytes: file, block, seq, at (offset of its magic), bytes, the header's fields,
    next (offset of the successor), whole (the piece holds all of the record), and digest of the body if so."""
    df = _header(_pieces(spark, path))
    size = F.octet_length("value")
    whole = (F.col("head_bytes") + F.col("body_bytes") + 4 == size) | (F.col("head_bytes") + F.col("body_bytes") + 4 < size)
    body = F.substr(F.col("value"), F.length("_head") + 1)
    body = F.when(whole, F.substring(body.cast("binary"), F.lit(1), F.col("body_bytes").cast("int")))
    slim = df.select("file", "block", "seq", size.cast("long").alias("bytes"), "head_bytes", "body_bytes", "record_type", "page", "url", "refers", "named_digest", "named_bytes", whole.alias("whole"), F.sha2(body, 256).alias("digest"))
    slim = stage_table(slim)
    # every piece but a file's last was followed by a magic
    step = F.col("bytes") + len(MAGIC)
    blocks = slim.groupBy("file", "block").agg(F.sum(step).alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), base.alias("_base"))
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = slim.withColumn("_in", inside).join(blocks, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    at = F.col("_base") + F.col("_in") - len(MAGIC)
    return df.withColumn("at", at).withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("body_bytes") + 4).drop("_f", "_b", "_base", "_in")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain file, at -> next reaches from offset 0, by pointer jumping: in round r
    the reached set grows by 2**r steps, and every pointer doubles its stride."""
    # tables of this size on disk are many times larger in memory: shuffle joins throughout
    jump = stage_table(chain.select("file", F.col("at").alias("frm"), F.col("next").alias("to")).filter("to is not null"))
    reached = stage_table(chain.filter("at = 0").select("file", "at"))
    count = reached.count()
    while True:
        far = reached.join(jump.hint("merge"), (reached["file"] == jump["file"]) & (reached["at"] == jump["frm"])).select(jump["file"], jump["to"].alias("at"))
        grown = stage_table(reached.union(far).distinct())
        after = grown.count()
        if after == count:
            # offsets past a file's last record are reached too, but hold no record
            return grown
        second = jump.select(F.col("file").alias("f2"), F.col("frm").alias("mid"), F.col("to").alias("end"))
        jump = stage_table(jump.join(second.hint("merge"), (F.col("file") == F.col("f2")) & (F.col("to") == F.col("mid"))).select("file", "frm", F.col("end").alias("to")))
        reached, count = grown, after


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives below ``path``: page_id (of ``id_type``), url, record_type, payload_bytes, payload_digest (of
    the full payload), refers_to. Bodies of responses are measured and hashed; revisits give what their headers
    name. A response whose digest differs from its header's fails the job."""
    pieces = candidates(spark, path)
    pieces = stage_table(pieces)
    kept = reachable(pieces.filter("at >= 0")).select(F.col("file").alias("_f"), F.col("at").alias("_at"))
    records = stage_table(pieces.filter("at >= 0").join(kept.hint("merge"), (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_at")), "left_semi"))
    broken = records.filter("not whole").select("file", "at", "next", "head_bytes", "body_bytes")
    if not broken.isEmpty():
        records = _mended(spark, path, pieces, records, broken)
    ok = (F.col("record_type") == "revisit") | (F.col("digest") == F.col("named_digest"))
    response = F.col("record_type") == "response"
    return records.select(
        F.url_decode("page").cast(id_type).alias("page_id"),
        "url",
        F.when(response, F.col("body_bytes")).otherwise(F.col("named_bytes")).alias("payload_bytes"),
        F.when(ok, F.when(response, F.col("digest")).otherwise(F.col("named_digest"))).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.coalesce("page", F.lit("null"))))).alias("payload_digest"),
        "record_type",
        F.url_decode("refers").cast(id_type).alias("refers_to"),
    )


def _mended(spark: SparkSession, path: str, pieces: DataFrame, records: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose body holds magics: their pieces are read again and joined in order."""
    spans = broken.select(F.col("file").alias("_f"), F.col("at").alias("start"), "next", "head_bytes", "body_bytes")
    # a piece belongs to the last kept record at or before it
    owner = F.last(F.when(F.col("_kept"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    marks = records.select(F.col("file").alias("_kf"), F.col("at").alias("_ka"), F.lit(True).alias("_kept"))
    owned = pieces.select("file", "block", "seq", "at", "bytes").join(marks, (F.col("file") == F.col("_kf")) & (F.col("at") == F.col("_ka")), "left").withColumn("owner", owner)
    parts = owned.join(spans, (F.col("file") == F.col("_f")) & (F.col("owner") == F.col("start"))).select(F.col("file").alias("_pf"), F.col("block").alias("_pb"), F.col("seq").alias("_ps"), F.col("bytes").alias("_pn"), "at", "owner", F.col("head_bytes").alias("hb"), F.col("body_bytes").alias("bb"))
    whole = _pieces(spark, path).join(parts, (F.col("file") == F.col("_pf")) & (F.col("block") == F.col("_pb")) & (F.col("seq") == F.col("_ps")))
    # pieces are numbered by their place in a scan: both scans must have cut the files alike
    same = F.octet_length("value") == F.col("_pn")
    whole = whole.withColumn("value", F.when(same, F.col("value")).otherwise(F.raise_error(F.lit("the archive was read in other pieces than before"))))
    joined = whole.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), F.first("hb").alias("hb"), F.first("bb").alias("bb"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).cast("binary")
    fixed = joined.select(F.col("file").alias("_xf"), F.col("owner").alias("_xa"), F.sha2(F.substring(text, F.col("hb") + 1, F.col("bb").cast("int")), 256).alias("_digest"))
    out = records.join(fixed, (F.col("file") == F.col("_xf")) & (F.col("at") == F.col("_xa")), "left")
    return out.withColumn("digest", F.coalesce("_digest", "digest")).drop("_xf", "_xa", "_digest")


def op3_warc_round_trip(spark, sf_dir):
    from .common import table

    path = shared_dir(spark)
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
