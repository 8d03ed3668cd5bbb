"""WARC archives with one Zstandard dictionary per file set.

Files follow the ``.warc.zst`` layout: a leading skippable frame holds the
dictionary, and each record is a frame of its own, compressed with it, so any
record can be read knowing only its offset and the file's start.  The
dictionary is built from a bounded sample of the records to be archived.
Payloads that occur again are written as revisit records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import commit, filesystem, materialize, new_path
from lectern.llm.workers import map_batches

#: Payloads under so many bytes are never written as revisits.
LEAST_REVISIT = 1000
#: The dictionary is built from about so many records, and at most so many bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 1500, 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
ROTATE_BYTES = 1 << 30

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id string, record_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, path string"


def _clean(value: str) -> str:
    """A header value: white space and control characters percent-encoded, as in a URL."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: quote(m[0]), value)


def _coded(value: str) -> str:
    """An id as a header value that gives it back exactly."""
    return quote(value, safe="")


def record_id(seed: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


def digest_field(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row: dict, date: str, archive: str) -> bytes:
    """The response or revisit record of one planned row; ``archive`` names the set, so record ids are its own."""
    payload = row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(f"{archive}/{row['key']}")), ("WARC-Date", date), ("WARC-Target-URI", _clean(row["url"] or "urn:none")), ("WARC-Payload-Digest", digest_field(row["digest"])), ("Content-Type", "application/http;msgtype=response")]
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", _coded(row["page_id"])))
    if row["lead_key"] is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{archive}/{row['lead_key']}")), ("WARC-Refers-To-Date", date)]
    if row["refers_to"] is not None:
        fields.append(("X-Refers-To-Page-ID", _coded(row["refers_to"])))
    return record("revisit", fields, http)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as it says")
    return fields, rest[:n]


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A Zstandard dictionary, or None where the samples are too few or too small to make one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes records to one file, visible under its name only when complete."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, dictionary: bytes | None, date: str, attempt: int, archive: str):
        self.fs, self.path, self.partial = fs, path, f"{path}.{attempt}.partial"
        self.out, self.bytes, self.records = fs.open_output_stream(self.partial, compression=None), 0, 0
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        else:
            self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.add(record("warcinfo", [("WARC-Record-ID", record_id(f"{archive}/{path}")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.packer.compress(data))
        self.records += 1

    def close(self) -> None:
        self.out.close()
        commit(self.fs, self.partial, self.path)


def read_records(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """Records of an archive one after another; memory holds one record."""
    unpacker, pending = zstandard.ZstdDecompressor(), b""

    def need(n: int) -> bool:
        nonlocal pending
        while len(pending) < n:
            more = stream.read(1 << 20)
            if not more:
                return False
            pending += more
        return True

    while need(4):
        magic = struct.unpack_from("<I", pending)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            if not need(8):
                raise ValueError("the archive ends within a frame")
            n = struct.unpack_from("<I", pending, 4)[0]
            if not need(8 + n):
                raise ValueError("the archive ends within a frame")
            if magic == SKIPPABLE:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(pending[8 : 8 + n]))
            pending = pending[8 + n :]
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not pending and not need(1):
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _record_columns() -> list:
    return [F.col("id").cast("string").alias("page_id"), "url", "payload", "digest", "bytes", F.col("row").cast("string").alias("key")]


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Every row with a number, its payload and the payload's digest."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    return materialize(rows, "payloads")


def plan(rows: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds to ``payloads`` the response that a revisit refers to.

    Of equal payloads of at least ``least`` bytes the row with the largest id
    is the response (a null id is smaller than any; of equal ids one).  Only
    payloads that occur again are joined: while they are few, Catalyst sees
    from the size of their table that no payload has to be shuffled.
    """
    again = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(F.struct("id", "row")).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(materialize(again, "again"), ["digest", "bytes"], "left")
    is_lead = F.coalesce(F.col("lead.row") == F.col("row"), F.lit(True))
    return joined.select("row", *_record_columns(), F.when(~is_lead, F.col("lead.row").cast("string")).alias("lead_key"), F.when(~is_lead, F.col("lead.id").cast("string")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, date: str | None = None, least: int = LEAST_REVISIT, rotate: int = ROTATE_BYTES) -> DataFrame:
    """Write all rows below ``folder`` (a URI that executors reach); returns ``path, records, bytes`` per file.

    Each task writes files of its own and renames them when complete, so a
    task that runs again, or twice at once, leaves whole files only.  Record
    ids are unique to this call.  White space and control characters of a URL
    are percent-encoded; page ids are, and come back as they were.  Null html
    is an empty payload; repeated rows are records of their own; an empty
    table writes no file.  Other columns are not archived.
    """
    archive = uuid.uuid4().hex
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = payloads(pages, id_col, url_col, html_col)
    planned = plan(rows, least)
    nothing = F.lit(None).cast("string")
    # About so many rows by a threshold on their hash: no task gathers the others' candidates.
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) * F.lit(float(max(1, rows.count()))) < F.lit(float(SAMPLE_RECORDS * (1 << 30)))
    sample = rows.where(chosen).withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES))
    sample = sample.select(*_record_columns(), nothing.alias("lead_key"), nothing.alias("refers_to")).toArrow().to_pylist()
    dictionary = train_dictionary([page_record(r, date, archive) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        done: list[Writer] = []
        writer = None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    writer = Writer(fs, f"{root}/part-{task.partitionId():05d}-{len(done):04d}.warc.zst", dictionary, date, task.taskAttemptId(), archive)
                writer.add(page_record(row, date, archive))
                if writer.bytes >= rotate:
                    writer.close()
                    done.append(writer)
                    writer = None
        if writer is not None:
            writer.close()
            done.append(writer)
        if done:
            yield pa.RecordBatch.from_pydict({"path": [folder.rstrip("/") + w.path.removeprefix(root) for w in done], "records": [w.records for w in done], "bytes": [w.bytes for w in done]})

    return map_batches(planned.drop("row"), run, "path string, records bigint, bytes bigint")


def read_archives(paths: DataFrame) -> DataFrame:
    """The page records of the archives named in column ``path``.

    Payload size and digest are those of the bytes read for responses, which
    must agree with the record's own, and those the record states for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                rows: list[dict] = []
                with contextlib.closing(fs.open_input_stream(name, compression=None)) as stream:
                    for data in read_records(stream):
                        fields, block = parse_record(data)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        rows.append(_read_page(fields, block) | {"path": path})
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
    return map_batches(paths.select("path"), run, FIELDS)


def _decoded(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def _read_page(fields: dict[str, str], block: bytes) -> dict:
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its record says")
    return {"page_id": _decoded(fields.get("X-Page-ID")), "record_id": fields["WARC-Record-ID"], "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": n, "payload_digest": stated, "refers_to": _decoded(fields.get("X-Refers-To-Page-ID"))}


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back: one row per page, ids as they were.

    Ids of any type that casts to a string and back; null ids stay null.
    """
    spark = pages.sparkSession
    files = materialize(write_archives(pages, folder or new_path(spark, "warc"), id_col, url_col, html_col), "files")
    n = files.count()
    back = read_archives(files.repartition(max(1, n)))
    kind = pages.schema[id_col].dataType
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest,
    CASE WHEN strlen(p) >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(p) >= 1000 AND page_id < m THEN m END AS refers_to
  FROM (SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)"""
