"""WARC archives: written as text by Spark, read back by boundary-chain verification.

Writing: one record to a page. Of pages with equal payloads the one with the smallest page_id is a response, the others
are revisits without the payload that refer to it. A task's records make one archive.

Reading: the archives are cut at every place where the magic of a record stands, in parallel splits of any file that is
not compressed as a whole; a payload may hold it too, so each cut is only a candidate for a record. A candidate's header gives the offset of
its successor. A file's true records are those that the chain of successors reaches from offset 0. Candidates that lead
to the next candidate in the file form runs; a run leads where its last candidate leads; pointer jumping over runs
doubles the reach in each round. Candidates that are not reached lie inside payloads and are put back into them.
Only offsets are shuffled, besides the few records that hold the magic themselves; they are scanned in sorted ranges, so that
one archive may hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import attach, lineage_cut, shared_folder, text_of
from pricelens.operators import ranges

#: What every record begins with, and how its first line goes on: any version 1.x is read, 1.0 is written.
MAGIC, VERSION = "WARC/1.", "0\r\n"
BREAK = "\r\n\r\n"
#: Payloads with fewer bytes are written out each time.
LEAST_BYTES = 0
#: Odd segments (see below) up to which they are broadcast.
BROADCAST_ODD = 20_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 10 hex digits are 8 digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _CONV32, _BASE32)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record_type, record): a record to a row, as text without the final break.

    Null html is an empty payload. White space and control characters in a url are percent-encoded as %20; a null url is
    left out. A very long html is one record, below 2 GB. A null page_id counts as the largest. Rows that share the smallest page_id of a payload are all responses."""
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    large = rows.where(F.col("bytes") >= least_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = attach(rows, "digest", first, "left", by=["page_id"])
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & (F.col("bytes") >= least_bytes)
    known = known.withColumn("again", again)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(BREAK))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "html"))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(line("WARC-Refers-To", identity("first")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))
    header = F.concat(
        F.lit(MAGIC + VERSION),
        line("WARC-Type", kind),
        line("WARC-Record-ID", identity("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("again"), refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return known.withColumn("block", block).select("page_id", kind.alias("record_type"), F.concat(header, "block").alias("record"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives below a folder that all executors share; a task that is run again replaces its file. They are
    gzipped: a task's share of the pages bounds an archive, so that it need not be split to be read."""
    records(pages, least_bytes).select("record").write.option("lineSep", BREAK).option("compression", "gzip").text(folder)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, at, value): what stands behind each magic, and before the first, in the files' order.

    at numbers the rows of a file's split in their order, but how splits are dealt to tasks, and so its value, may differ from
    one scan to the next. So the cuts are written to a table once, and all that follows reads that."""
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    cuts = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    written = shared_folder(spark)
    cuts.write.option("compression", "zstd").parquet(written)
    return spark.read.parquet(written)


def _field(name: str, headers: Column) -> Column:
    return F.regexp_extract(headers, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def _headers(value: str | Column) -> Column:
    return F.substring_index(value, BREAK, 1)


def chain(found: DataFrame) -> DataFrame:
    """(file, block, at, real, owner, parts): whether a candidate is a record; if not, the at of the record that holds it;
    parts: the candidates that make up the record. What stands before a file's first magic is no record either. Only offsets
    go through the shuffle."""
    headers = _headers("value")
    length = F.try_to_number(F.nullif(F.trim(_field("Content-Length", headers)), F.lit("")), F.lit("9" * 18)).cast("long")
    span = F.when(F.col("value").rlike(r"^[0-9]\r\n"), F.octet_length(headers) + 4 + length + 4)
    order = ["block", "at"]
    spots = ranges.ranged(found.select("file", *order, F.octet_length("value").alias("bytes"), span.alias("span")), ["file"], order)
    upto = ranges.running(spots, ["file"], order, {"place": ("sum", F.lit(1).cast("long")), "upto": ("sum", (F.col("bytes") + len(MAGIC)).cast("long"))})
    begin = F.when(F.col("place") > 1, F.col("upto") - F.col("bytes") - 2 * len(MAGIC))
    spots = upto.withColumn("begin", begin).withColumn("succ", F.col("begin") + len(MAGIC) + F.col("span"))
    # A candidate to which the one before it leads goes on with that one's run. The first piece of a file is a run of its own.
    linked = ranges.running(spots, ["file"], order, {"led": ("last", F.struct("succ"))}, before=True)
    opens = F.when(F.coalesce(F.col("led")["succ"] == F.col("begin"), F.lit(False)), 0).otherwise(1)
    linked = ranges.running(linked.withColumn("opens", opens), ["file"], order, {"run": ("sum", F.col("opens").cast("long"))})
    linked = lineage_cut(linked.select("file", *order, "begin", "succ", "run", ranges.PART))

    ends = linked.groupBy("file", "run").agg(F.max_by("succ", "begin").alias("entry"))
    target = linked.select("file", F.col("begin").alias("entry"), F.col("run").alias("next"))
    jump = lineage_cut(ends.join(target, ["file", "entry"], "left").where(F.col("next").isNull() | (F.col("next") > F.col("run"))))
    reached = linked.where("begin = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    reached = lineage_cut(reached)
    size, leaps = reached.count(), jump.where("next is not null").select("file", "run", "next", "entry")
    while True:
        # entry belongs to next: where the chain enters that run.
        ahead = reached.select("file", "run").join(leaps, ["file", "run"]).select("file", F.col("next").alias("run"), "entry")
        reached = lineage_cut(reached.unionByName(ahead).distinct())
        if (now := reached.count()) == size:
            break
        size, second = now, leaps.select("file", F.col("run").alias("next"), F.col("next").alias("far"), F.col("entry").alias("far_entry"))
        leaps = lineage_cut(leaps.join(second, ["file", "next"]).select("file", "run", F.col("far").alias("next"), F.col("far_entry").alias("entry")))
    # A run is reached once, from its first reached candidate on, so facts about runs have a row to each.
    entered = reached.groupBy("file", "run").agg(F.min("entry").alias("from"))
    judged = linked.join(entered, ["file", "run"], "left").withColumn("real", F.coalesce(F.col("begin") >= F.col("from"), F.lit(False)))
    owned = ranges.running(judged, ["file"], order, {"own": ("last", F.when(F.col("real"), F.struct("at", "succ")))})
    owned = lineage_cut(owned.withColumn("owner", F.when(F.col("own")["succ"] > F.col("begin"), F.col("own")["at"])).select("file", *order, "real", "owner"))
    parts = owned.where("owner is not null").groupBy("file", "owner").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return owned.join(parts, ["file", "owner"], "left").select("file", *order, "real", "owner", "parts")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row to a true record: page_id, url, record_type, refers_to, payload (null in a revisit), and of the full payload
    payload_bytes and payload_digest (of a response both are computed from what was read, of a revisit as it states them).

    Records of any version 1.x are read, of any length that Spark's text source reads as a row (below 2 GB). Bytes that no
    chain reaches from a file's start are left out, so is all of a file that doesn't start with a record. Files are told apart
    by path, so rows that repeat stay; an empty folder gives no rows."""
    found = candidates(spark, folder)
    # Odd segments: no record, or a record of several segments. Most archives have none; the others are records as they are.
    odd = lineage_cut(chain(found).where("not real or parts > 1").select("file", "block", "at", "owner"))
    few = odd.count() <= BROADCAST_ODD
    key = ["file", "block", "at"]
    known = F.broadcast(odd) if few else odd
    whole = found.join(known.select(*key), key, "left_anti").select("file", "value").where(F.col("value") != "")
    # A record's segments, put together around the magic that its payload holds.
    pieces = found.join(known.where("owner is not null"), key).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("all"))
    joined = pieces.select("file", F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).alias("value"))
    return parse(whole.unionByName(joined))


def parse(segments: DataFrame) -> DataFrame:
    headers = _headers("value")
    length = F.try_to_number(F.nullif(F.trim(_field("Content-Length", headers)), F.lit("")), F.lit("9" * 18)).cast("int")
    block = F.col("value").cast("binary").substr(F.octet_length(headers) + 5, length)
    rows = segments.select(headers.alias("headers"), block.alias("block"), "file").where(F.col("block").isNotNull())
    http = F.substring_index(F.col("block").cast("string"), BREAK, 1)
    number = lambda x: F.nullif(F.regexp_extract(x, r"<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    rows = rows.select(
        number(_field("WARC-Record-ID", F.col("headers"))).alias("page_id"),
        F.nullif(_field("WARC-Target-URI", F.col("headers")), F.lit("")).alias("url"),
        _field("WARC-Type", F.col("headers")).alias("record_type"),
        number(_field("WARC-Refers-To", F.col("headers"))).alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest", F.col("headers")), "^sha1:", "").alias("stated"),
        _field("Content-Length", http).cast("long").alias("stated_bytes"),
        F.col("block").substr(F.octet_length(http) + 5, F.octet_length("block")).alias("payload"),
    )
    again = F.col("record_type") == "revisit"
    return rows.select(
        "page_id", "url", "record_type", "refers_to",
        F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, F.col("stated_bytes")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.col("stated")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
    )
