"""Web archives: legacy ARC files, their conversion to WARC, and WARC files.

Archives are written by Spark's text writer, compressed as a whole: the line separator is what closes a
record (a line feed in ARC, two CR LF in WARC), and a record's bytes are cast, not re-encoded. A task starts a
new file after so many records. They are read by Spark's binary file reader, so any path Spark can read will do.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: records of one archive file, which a task reads as a whole
RECORDS_PER_FILE = 2_000

#: smaller payloads are written out however often they occur
REVISIT_BYTES = 100

# Fixed values of the formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_VERSION = "WARC/1.1"

_BATCH_BYTES = 4 << 20


def _write(records: DataFrame, folder: str, close: str, per_file: int) -> None:
    writer = records.write.option("lineSep", close).option("maxRecordsPerFile", per_file)
    # a fifth larger than at the default level, in a third of the time
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


# ------------------------------------------------------------------ ARC

#: the last millisecond of the year 9999
LAST_MS = 253_402_300_799_999


def write_arc(events: DataFrame, folder: str, version: int = 1, per_file: int = RECORDS_PER_FILE) -> None:
    """Write events (event_id, url, ts in epoch ms, payload) as compressed ARC files of version 1 or 2.

    A record holds an HTTP response with the payload in UTF-8 (null: empty) and the event_id in a header. Null
    urls become urn:event:<id>, white space in urls is percent-encoded, null times are the epoch. The format has
    four digits for a year: times before the epoch or after the year 9999 become the first or last of that span.
    """
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    url = F.coalesce(
        F.nullif(F.regexp_replace(F.col("url").cast("string"), r"\s", "%20"), F.lit("")),
        F.concat(F.lit("urn:event:"), F.coalesce(F.col("event_id").cast("string"), F.lit(""))),
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Event-Id: "),
        F.coalesce(F.col("event_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.concat(head, payload)
    ts = F.least(F.greatest(F.coalesce(F.col("ts").cast("bigint"), F.lit(0)), F.lit(0)), F.lit(LAST_MS))
    at = F.date_format(F.timestamp_millis(ts), "yyyyMMddHHmmss")
    fields = [url, F.lit("0.0.0.0"), at, F.lit("text/html")]
    if version == 2:
        # result code, checksum, location, offset, file name; unknown ones are dashes
        fields += [F.lit("200"), F.crc32(body.cast("binary")).cast("string"), F.lit("-"), F.lit("0"), F.lit("-")]
    line = F.concat_ws(" ", *fields, F.octet_length(body).cast("string"))
    records = events.select(F.concat(line, F.lit("\n"), body).alias("value"))

    def with_version_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = f"{version} 0 barline\n{ARC_FIELDS[version]}\n"
        rest = "" if version == 1 else "200 - - 0 - "
        first = f"filedesc://barline.arc 0.0.0.0 19700101000000 text/plain {rest}{len(block)}\n{block}"
        room = 0  # records until the writer starts another file, which begins with a version block
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if not room:
                    yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
                    room = per_file - 1
                part = batch.column(0).slice(at, room)
                yield pa.RecordBatch.from_arrays([part], names=["value"])
                at, room = at + len(part), room - len(part)

    _write(records.mapInArrow(with_version_block, "value string"), folder, "\n", per_file)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, by the header line its version lays down and the length this line declares.

    A record that ends early (the file is cut) is marked truncated. A line that is no header is given as an
    error, and reading goes on behind it.
    """
    at, fields, begun = 0, ARC_FIELDS[1].split(), False
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        # only a file's first record is its version block; it tells the version of its own header line, too
        first, begun = not begun and line.startswith(b"filedesc://"), True
        if first and (m := re.match(rb"([0-9]+) ", data[end + 1 : end + 12])):
            fields = ARC_FIELDS.get(int(m[1]), ARC_FIELDS[1]).split()
        parts = line.rsplit(b" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit() or not re.fullmatch(rb"[0-9]{12,14}", parts[2]):
            yield {"offset": at, "error": "no header line"}
            at = end + 1
            continue
        named = dict(zip(fields, (p.decode("utf-8", "replace") for p in parts)))
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        yield {"offset": at, "version": 1 if len(fields) == 5 else 2, "block": first, "body": body, "truncated": len(body) < length, **named}
        at = end + 1 + length


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP message; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _http_header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m and m[1] else None


def _batched(names: dict[str, pa.DataType], rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    schema = pa.schema(list(names.items()))
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 200
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read_files(spark: SparkSession, folder: str, names: dict[str, pa.DataType], parse: Callable[[str, bytes], Iterator[dict]]):
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if data.startswith(b"\x1f\x8b"):
                    data = gzip.decompress(data)  # one member or one for each record
                yield from _batched(names, parse(name, data))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in names.items()))


_CONVERTED = {
    "record_id": pa.string(),
    "type": pa.string(),
    "date": pa.string(),
    "uri": pa.string(),
    "ip": pa.string(),
    "mime": pa.string(),
    "event_id": pa.string(),
    "head": pa.binary(),
    "payload": pa.binary(),
    "truncated": pa.bool_(),
    "error": pa.string(),
}


def _convert(path: str, data: bytes) -> Iterator[dict]:
    name = path.rsplit("/", 1)[-1]
    for r in parse_arc(data):
        # the same archive gives the same identifiers again
        key = hashlib.sha256(f"{name}:{r['offset']}".encode()).digest()[:16]
        record_id = f"<urn:uuid:{uuid.UUID(bytes=key, version=4)}>"
        if "error" in r:
            yield {"record_id": record_id, "error": f"{name}:{r['offset']}: {r['error']}"}
            continue
        d = r["Archive-date"].ljust(14, "0")
        head, payload = _split_http(r["body"])
        kind = "warcinfo" if r["block"] else "response" if head else "resource"
        mime = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind, r["Content-type"])
        yield {
            "record_id": record_id,
            "type": kind,
            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
            "uri": r["URL"],
            "ip": r["IP-address"],
            "mime": mime,
            "event_id": _http_header(head, "X-Event-Id"),
            "head": head,
            "payload": payload,
            "truncated": r["truncated"],
        }


def convert_arc(spark: SparkSession, folder: str, id_type: str = "string") -> DataFrame:
    """WARC records equivalent to those of the ARC files in a folder.

    Columns: record_id (a UUID made of the archive's name and the record's offset), type (warcinfo for the
    version block, response for HTTP, else resource; revisit for repeats), date (ISO), uri, ip, mime,
    event_id (of the archived header, as ``id_type``; null without one), head, payload, truncated,
    payload_digest (bare hex SHA-256), refers_to (a record_id) and error. Of responses with equal payloads of
    100 bytes or more, that with the smallest event_id (null last, then record_id) stays a response; the
    others become revisits of it. Rows with an error hold no record.
    """
    records = _read_files(spark, folder, _CONVERTED, _convert)
    records = records.withColumn("event_id", F.col("event_id").cast(id_type)).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )
    large = (F.col("type") == "response") & (F.octet_length("payload") >= REVISIT_BYTES)
    rank = F.struct(F.col("event_id").isNull().alias("none"), "event_id", "record_id")
    firsts = records.filter(large).groupBy("payload_digest").agg(F.min(rank)["record_id"].alias("_first"))
    again = large & (F.col("_first") != F.col("record_id"))
    return (
        records.join(firsts, "payload_digest", "left")
        .withColumn("refers_to", F.when(again, F.col("_first")))
        .withColumn("type", F.when(again, F.lit("revisit")).otherwise(F.col("type")))
        .drop("_first")
    )


# ------------------------------------------------------------------ WARC


def write_warc(records: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE, skip_errors: bool = False) -> None:
    """Write records as ``convert_arc`` gives them; revisits keep the HTTP head and leave out the payload.

    A row with an error fails the job, so that nothing is lost unseen; with ``skip_errors`` it is left out.
    """
    block = F.when(F.col("type") == "revisit", F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("type") == "revisit"
    head = F.concat(
        F.lit(f"{WARC_VERSION}\r\n"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("uri"))),
        line("WARC-IP-Address", F.when(F.col("type") != "warcinfo", F.col("ip"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Truncated", F.when(F.col("truncated"), F.lit("length"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        line("Content-Type", F.col("mime")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    if skip_errors:
        records = records.filter("error IS NULL")
    whole = F.concat(head.cast("binary"), block).cast("string")
    ready = records.select(F.when(F.col("error").isNull(), whole).otherwise(F.raise_error(F.col("error"))).alias("value"))
    _write(ready, folder, "\r\n\r\n", per_file)


_WARC = {
    "record_id": pa.string(),
    "type": pa.string(),
    "date": pa.string(),
    "uri": pa.string(),
    "event_id": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to_id": pa.string(),
    "payload": pa.binary(),
    "error": pa.string(),
}


def parse_warc(path: str, data: bytes) -> Iterator[dict]:
    """Records of a WARC file, by the lengths that they declare; the digests of payloads are checked."""
    at, name = 0, path.rsplit("/", 1)[-1]
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        fields = dict(re.findall(rb"(?m)^([A-Za-z-]+):[ \t]*([^\r\n]*)", data[at:end])) if end > 0 else {}
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in fields.items()}
        if not data.startswith(b"WARC/", at) or not fields.get("content-length", "").isdigit():
            yield {"error": f"{name}:{at}: no record header"}
            return
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        head, payload = _split_http(block)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        kind, error = fields.get("warc-type"), None
        if len(block) < length or kind != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
            error = f"{name}:{at}: block is cut or differs from its digest"
        size = _http_header(head, "Content-Length") if kind == "revisit" else len(payload)
        yield {
            "record_id": fields.get("warc-record-id"),
            "type": kind,
            "date": fields.get("warc-date"),
            "uri": fields.get("warc-target-uri"),
            "event_id": _http_header(head, "X-Event-Id"),
            "payload_bytes": int(size) if size is not None else None,
            "payload_digest": digest,
            "refers_to_id": fields.get("warc-refers-to"),
            "payload": None if kind == "revisit" else payload,
            "error": error,
        }
        at = end + 4 + length


def read_warc(spark: SparkSession, folder: str, id_type: str = "string") -> DataFrame:
    """The records of the WARC files in a folder.

    Columns: record_id, type, date, uri, event_id (as ``id_type``), payload_bytes and payload_digest (of the
    full payload, also for revisits), refers_to (the event_id of a revisit's response), payload (null for
    revisits) and error (null for good records).
    """
    records = _read_files(spark, folder, _WARC, parse_warc).withColumn("event_id", F.col("event_id").cast(id_type))
    named = records.select(F.col("record_id").alias("refers_to_id"), F.col("event_id").alias("refers_to"))
    again = records.filter(F.col("refers_to_id").isNotNull()).drop("payload").join(named, "refers_to_id", "left")
    once = records.filter(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast(id_type))
    columns = ["record_id", "type", "date", "uri", "event_id", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    return once.select(*columns).unionByName(again.withColumn("payload", F.lit(None).cast("binary")).select(*columns))
