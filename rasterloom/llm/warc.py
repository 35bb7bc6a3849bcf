"""WARC archives: write records, read them back by their boundary chain.

Archives are gzipped files of records, written and read by Spark's own text source, so
any store that Spark reaches will do: the writer's line separator is the blank lines
that end a record, the reader's is what begins one in every version 1. The reader cuts a file at
every magic; each cut is a candidate with an offset and, by its Content-Length, a
successor. Pointer jumping from the file's start keeps the candidates that the chain
reaches and rejects a magic inside a payload; a payload that holds one is put together
again from its pieces.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, use_checkpoints

#: Fixed values of the format (ISO 28500).
MAGIC = "WARC/1."  # and then the minor version and a line's end
VERSION = "0\r\n"
END = "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000


def base32(digest: Column) -> Column:
    """A SHA-1 in hex as base32: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    """A page's name: its id as text, percent-encoded; a null id has none."""
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page.cast("string"))), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """One record for each row. Of rows whose payloads are equal and have ``least`` bytes or more, that of the smallest id is a response and the others revisit it.

    A null payload is empty. Rows that tie for the smallest id are all responses; null ids revisit the smallest
    id there is, and are responses where there is none. Control characters in an address are percent-encoded;
    a null address is left out. Ids of any type are kept as text, percent-encoded. Repeated rows give repeated records;
    an empty table gives no record. A record of any length is one line of Spark's text writer, held by its task.
    """
    rows = pages.select(column(id_col).alias("id"), column(url).cast("string").alias("url"), F.coalesce(column(html).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("size", F.octet_length("body"))
    first = rows.groupBy("sha").agg(F.min("id").alias("first"))  # narrow: summed before the shuffle
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.join(first, "sha").withColumn("again", again)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F]", "%20")
    stored = F.when(F.col("again"), F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit(MAGIC + VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\n")),
        _line("WARC-Target-URI", safe),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("first")))),
        _line("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        _line("WARC-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: text/html\r\n"),
        F.concat(F.lit("Content-Length: "), stored.cast("string"), F.lit(END)),
    )
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("body").cast("string"))
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _candidates(pieces: DataFrame) -> DataFrame:
    """What each piece says if it is a record: the header's fields, the record's length, and the payload where the piece holds it whole."""
    end = F.when(F.col("value").rlike(r"\A[0-9]\r\n"), F.instr("value", END)).otherwise(0)
    head = F.when(F.col("end") > 0, F.expr("substring(value, 1, end + 1)")).otherwise("")
    at = F.octet_length(head) + 2  # bytes before the payload
    df = pieces.withColumn("end", end).withColumn("head", head).withColumn("at", at)
    field = lambda name, value: F.regexp_extract("head", f"(?:^|\r\n){name}: {value}\r\n", 1)
    df = df.withColumn("stored", field("Content-Length", "([0-9]{1,18})").try_cast("long"))
    df = df.withColumn("record", F.when((F.col("end") > 0) & F.col("stored").isNotNull(), F.lit(len(MAGIC)) + F.col("at") + F.col("stored") + F.lit(len(END))))
    whole = F.col("record") <= F.col("length")
    body = F.when(whole, F.expr("substring(cast(value as binary), cast(at + 1 as int), cast(stored as int))"))
    return df.select(
        "file", "split", "nth", "length", "record", "stored", "at",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Record-ID", "<([^>\r\n]*)>").alias("name"),
        field("WARC-Refers-To", "<([^>\r\n]*)>").alias("refers"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("said"),
        field("WARC-Payload-Length", "([0-9]{1,18})").try_cast("long").alias("full"),
        F.sha1(body).alias("sha"),
    )


def _pieces(df: DataFrame) -> DataFrame:
    """Each file cut at the magic, in order: split, and nth within a split, rise along a file. The first piece lies before the first magic and is empty in a sound file."""
    return df.select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth")).withColumn("length", F.octet_length("value") + F.lit(len(MAGIC)))


def jump(length: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a file's pieces (in order), and which of them the chain from offset 0 reaches.

    length: bytes from one magic to the next; record: bytes of the record that would begin there, -1 if none can.
    Pointer jumping: each round doubles every pointer's reach and marks what marked pieces point to, so n records take log2(n) rounds.
    """
    n = len(length)
    offset = np.cumsum(length) - length - len(MAGIC)
    due = offset + record
    to = np.searchsorted(offset, due)
    to = np.where((record >= 0) & (to < n) & (offset[np.minimum(to, n - 1)] == due), to, n)
    to = np.r_[to, n]
    marked = np.r_[(offset == 0) & (record >= 0), False]
    good = np.r_[record >= 0, False]
    for _ in range(n.bit_length() + 1):
        marked[to[marked]] = True
        to = to[to]
    return offset, (marked & good)[:n]


def read(spark, path: str, id_type: str = "string") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, name, file, offset) of every record that the chains of the archives under ``path`` reach.

    name is the record's own; id and refers_to are what ``write`` was given, as ``id_type``, and null for records of other
    writers and ids that aren't of that type. A payload that differs from its digest, where it has one, fails the job; of a
    revisit digest and length are what its header says. Repeated records stay; archives without a record give no rows;
    a payload of any length, with a magic inside or not, is put together by one task.
    """
    page = lambda c: F.url_decode(F.regexp_extract(F.nullif(F.col(c), F.lit("")), "^urn:page:(.*)$", 1))
    known = lambda c: F.when(F.col(c).startswith("urn:page:"), page(c)).try_cast(id_type)
    text = lambda: _pieces(spark.read.option("lineSep", MAGIC).text(path))
    seen = cut(_candidates(text()))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["split", "nth"])
        offset, reached = jump(pdf["length"].to_numpy(np.int64), pdf["record"].fillna(-1).to_numpy(np.int64))
        return pd.DataFrame({"file": pdf["file"], "nth": pdf["nth"], "offset": offset})[reached]

    # five narrow columns of one file, whose number of records is bounded
    reached = seen.select("file", "split", "nth", "length", "record").groupBy("file").applyInPandas(chain, "file string, nth long, offset long")
    kept = cut(seen.join(reached, ["file", "nth"]))
    broken = kept.where("sha is null")
    sha = F.col("sha")
    if broken.limit(1).count():  # payloads that hold the magic: put their pieces together
        w = Window.partitionBy("file").orderBy("split", "nth")
        again = text().join(broken.select("file").distinct(), "file", "left_semi")
        again = again.withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length") - len(MAGIC))
        again = again.join(kept.select("file", "offset", F.col("offset").alias("start")), ["file", "offset"], "left").withColumn("start", F.max("start").over(w))
        again = again.join(broken.select("file", F.col("offset").alias("start"), "at", "stored"), ["file", "start"])
        whole = again.groupBy("file", F.col("start").alias("offset"), "at", "stored").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "nth", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        mended = whole.select("file", "offset", F.sha1(F.expr("substring(cast(value as binary), cast(at + 1 as int), cast(stored as int))")).alias("mended"))
        kept = kept.join(mended, ["file", "offset"], "left")
        sha = F.coalesce("sha", "mended")
    own = base32(sha)
    revisit = F.col("record_type") == "revisit"
    bad = ~revisit & (((F.col("said") != "") & (own != F.col("said"))) | (F.col("stored") != F.col("full")))
    bad = F.coalesce(bad, F.lit(False))
    return kept.select(
        known("name").alias("id"),
        F.when(revisit, F.col("full")).otherwise(F.col("stored")).alias("payload_bytes"),
        F.when(bad, F.raise_error(F.concat(F.lit("payload differs from its digest: "), "name"))).when(revisit, F.col("said")).otherwise(own).alias("payload_digest"),
        "record_type",
        known("refers").alias("refers_to"),
        "name",
        "file",
        "offset",
    )


def archive_path(spark) -> str:
    return f"{use_checkpoints(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
