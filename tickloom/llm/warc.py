"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing.  A record is its headers, an HTTP head and the payload, all UTF-8, so Spark's text writer with a
blank line as separator writes valid archives to any Hadoop file system and commits them task by task.
Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a
response and the others are revisits that refer to it.

Reading.  Archives are split at any byte: every occurrence of the magic is a candidate, found by Spark's
splittable text reader with the magic as separator.  A task knows where a candidate lies within its
block; blocks' lengths, summed up within each file, make that an offset in the file.  A candidate's
headers tell where its successor must begin.  From offset 0 of each file, pointers to successors are
followed and doubled until nothing new is reached; only candidates on the chain are records, so
magic inside a payload is rejected.  A chain that leads nowhere ends the file's records there.

A file's candidates, some 40 bytes each, are verified in one group: its size is the file's, which the
writer bounds by MAX_RECORDS.  Payloads aren't shuffled: each candidate's payload is hashed where it is
read; only records whose payload has the magic in it are read a second time and put together.

Null html is an empty payload, null urls have no target header, and line breaks in urls are escaped.  Equal
payloads with null page_ids refer to the smallest id that isn't null; if all are null, all are responses.
Rows that repeat the smallest page_id are all responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_or_shuffled, stage_out

MIN_REVISIT = 100
MAX_RECORDS = 50_000
MAGIC = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id string, uri string, type string, refers_to string, payload_bytes long, payload_digest string"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.sha2(_payload().cast("binary"), 256)


def _id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


def revisits(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """_page, _digest, _first of the pages that are revisits, each once."""
    keys = stage_out(spark, pages.select(F.col("page_id").cast("long").alias("_page"), _digest().alias("_digest"), F.octet_length(_payload()).alias("_size")).where(F.col("_size") >= MIN_REVISIT), "keys")
    first = keys.groupBy("_digest").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    return stage_out(spark, keys.join(first, "_digest").where(~F.col("_page").eqNullSafe(F.col("_first"))).select("_page", "_digest", "_first").distinct(), "revisits")


def write_warc(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Archives of all rows of pages (page_id, url, html) in a folder."""
    again = revisits(spark, pages)
    page = F.col("page_id").cast("long")
    rows = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"), _digest().alias("digest"))
    rows = rows.join(small_or_shuffled(again, 4 * again.count()), rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    revisit = F.col("_first").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _id(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.when(revisit, _id(F.col("_first")))), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(head) + F.when(revisit, 0).otherwise(F.octet_length("payload"))).cast("string"),
        F.lit("\r\n\r\n"),
        head,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def parse(block: bytes | memoryview) -> tuple[int, dict | None]:
    """(bytes from the magic to the successor, fields) of a record's bytes after the magic; (-1, None) if they aren't one.

    fields are None if the bytes end before the record does.
    """
    raw = bytes(block)
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw[:1].isdigit() or raw[1:3] != b"\r\n":
        return -1, None
    headers = {}
    for line in raw[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return -1, None
        headers[name.strip().lower()] = value.strip()
    length = headers.get(b"content-length", b"")
    if not length.isdigit():
        return -1, None
    at, stop = end + 4, end + 4 + int(length)
    need = len(MAGIC) + stop + 4
    if len(raw) < stop:
        return need, None
    body = raw[at:stop]
    size, digest = len(body), None
    kind = headers.get(b"warc-type", b"").decode("utf-8", "replace")
    if headers.get(b"content-type", b"").startswith(b"application/http"):
        http, _, body = body.partition(b"\r\n\r\n")
        size = len(body)
        if kind == "revisit":
            declared = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(declared[0]) if declared and declared[0].isdigit() else 0
            digest = headers.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:")
    text = {k: headers[k].decode("utf-8", "replace") for k in (b"warc-record-id", b"warc-target-uri", b"warc-refers-to") if k in headers}
    fields = {"page_id": text.get(b"warc-record-id"), "uri": text.get(b"warc-target-uri"), "type": kind, "refers_to": text.get(b"warc-refers-to"), "payload_bytes": size, "payload_digest": digest or hashlib.sha256(body).hexdigest()}
    return need, fields


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between occurrences of the magic, with file and block."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, pa.Scalar]]:
    """(file, block, number and offset within the block, bytes) of each piece, in the reader's order."""
    here, nth, at = None, 0, 0
    for batch in batches:
        for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if (file, block) != here:
                here, nth, at = (file, block), 0, 0
            raw = memoryview(value.as_buffer())
            yield file, block, nth, at, raw
            nth, at = nth + 1, at + len(raw) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, at (within the block), size, need, whole and FIELDS of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "nth", "at", "size", "need", "whole"]
        rows: list[dict] = []

        def flush() -> pa.RecordBatch:
            kinds = [("file", pa.string()), *((n, pa.int64()) for n in names[1:6]), ("whole", pa.bool_()), *((n, pa.int64() if n == "payload_bytes" else pa.string()) for n in ("page_id", "uri", "type", "refers_to", "payload_bytes", "payload_digest"))]
            return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

        for file, block, nth, at, raw in _numbered(batches):
            need, fields = parse(raw)
            # a whole record is followed by the next magic at once, or by the file's end
            whole = fields is not None and len(MAGIC) + len(raw) == need
            rows.append({"file": file, "block": block, "nth": nth, "at": at, "size": len(raw), "need": need, "whole": whole} | (fields if whole else {}))
            if len(rows) == 5000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return _pieces(spark, path).mapInArrow(run, f"file string, block long, nth long, at long, size long, need long, whole boolean, {FIELDS}")


def reachable(offset: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping. offset: ascending."""
    n = len(offset)
    jump = np.searchsorted(offset, follows)
    jump = np.where((jump < n) & (offset[np.minimum(jump, n - 1)] == follows), jump, n)
    jump = np.append(jump, n)  # n: nowhere
    found = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        found[0] = True
    while True:
        more = found.copy()
        more[jump[np.flatnonzero(found)]] = True
        more[n] = False
        if (more == found).all():
            return found[:n]
        found, jump = more, jump[jump]


def verified(spark: SparkSession, found: DataFrame) -> DataFrame:
    """file, block, nth, offset, follows, pieces of each record. found: a written table of candidates()."""
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    # a piece's magic stands before it; before a file's first piece there is none
    rows = found.select("file", "block", "nth", "at", "size", "need").join(starts, ["file", "block"]).select("file", "block", "nth", (F.col("start") + F.col("at") - len(MAGIC)).alias("offset"), "size", "need")

    def chain(t: pa.Table) -> pa.Table:
        offset, need = t["offset"].to_numpy(), t["need"].to_numpy()
        order = np.argsort(offset, kind="stable")
        order = order[offset[order] >= 0]
        offset, need = offset[order], need[order]
        end = int(offset[-1] + len(MAGIC) + t["size"].to_numpy()[order[-1]]) if len(order) else 0
        follows = np.where(need > 0, offset + need, -1)
        keep = reachable(offset, follows) & (need > 0) & (follows <= end)
        at = np.searchsorted(offset, follows)
        rows = order[keep]
        out = t.select(["file", "block", "nth"]).take(pa.array(rows))
        return pa.table([*out.columns, pa.array(offset[keep]), pa.array(follows[keep]), pa.array((at - np.arange(len(offset)))[keep])], ["file", "block", "nth", "offset", "follows", "pieces"])

    return rows.groupBy("file").applyInArrow(chain, "file string, block long, nth long, offset long, follows long, pieces long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, follows and FIELDS of each verified record, digests computed from the bytes read."""
    found = stage_out(spark, candidates(spark, path), "candidates")
    records = stage_out(spark, verified(spark, found), "records")
    fields = [c.split()[0] for c in FIELDS.split(", ")]
    plain = found.join(records, ["file", "block", "nth"]).where("whole").select("file", "offset", "follows", *fields)
    broken = records.join(found.where("not whole").select("file", "block", "nth"), ["file", "block", "nth"], "left_semi")
    if broken.isEmpty():
        return plain
    return plain.unionByName(_reassembled(spark, path, found, stage_out(spark, broken, "broken")))


def _reassembled(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Records of several pieces: their pieces, and theirs only, are read again and put together."""
    order = Window.partitionBy("file").orderBy("block", "nth")
    files = broken.select("file").distinct()
    numbered = found.join(files, "file", "left_semi").select("file", "block", "nth", F.row_number().over(order).alias("k"))
    head = numbered.join(broken, ["file", "block", "nth"]).select("file", F.col("k").alias("k0"), "offset", "follows", "pieces")
    # each piece's place in its record: one row for every piece of a broken record
    places = head.select("file", "offset", "follows", F.posexplode(F.sequence("k0", F.col("k0") + F.col("pieces") - 1)).alias("i", "k"))
    places = stage_out(spark, numbered.join(places, ["file", "k"]).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("nth").alias("_nth"), "offset", "follows", "i"), "places")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, nth, _, raw in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([nth]), pa.array([bytes(raw)], pa.binary())], ["file", "block", "nth", "value"])

    pieces = _pieces(spark, path).mapInArrow(number, "file string, block long, nth long, value binary")
    own = pieces.join(small_or_shuffled(places, 8 * places.count()), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("nth") == F.col("_nth")))

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        need, fields = parse(MAGIC.join(x.as_py() for x in t["value"]))
        names = ["page_id", "uri", "type", "refers_to", "payload_bytes", "payload_digest"]
        row = {"file": t["file"][0].as_py(), "offset": t["offset"][0].as_py(), "follows": t["follows"][0].as_py()} | {n: (fields or {}).get(n) for n in names}
        kinds = [("file", pa.string()), ("offset", pa.int64()), ("follows", pa.int64()), *((n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names)]
        return pa.Table.from_pylist([row] if fields else [], pa.schema(kinds))

    return own.select("file", "offset", "follows", "i", "value").groupBy("file", "offset").applyInArrow(together, f"file string, offset long, follows long, {FIELDS}")


def resolved(spark: SparkSession, records: DataFrame) -> DataFrame:
    """records with `resolved`: whether a revisit's digest and size are those that a response it refers to was read with; true for all others.

    A revisit brings no payload: its digest and size are only what its headers say, until they are held against the response's.
    """
    records = stage_out(spark, records, "read")
    said = records.where("type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    there = records.where("type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    good = said.join(there, ["refers_to", "payload_digest", "payload_bytes"]).select(F.col("refers_to").alias("_r"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"), F.lit(True).alias("_good"))
    out = records.join(good, (F.col("refers_to") == F.col("_r")) & (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")), "left")
    return out.select(*records.columns, ((F.col("type") != "revisit") | F.col("_good").isNotNull()).alias("resolved"))


def page_number(c: str) -> Column:
    return F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    path = f"{shared_dir(spark)}/archives"
    write_warc(spark, pages, path)
    found = resolved(spark, read_warc(spark, path))
    return found.select(page_number("page_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_number("refers_to").alias("refers_to"), "resolved")
