"""WARC archives: one gzip member a record, written by tasks, and a reader that splits files at any byte."""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, stored
from offerlens.session import checkpoint_dir

#: Bytes of a split, and of one read of a task.
SPLIT = 16 << 20
BLOCK = 1 << 20
#: Payloads below this size are never stored as a revisit.
LEAST_REVISITED = 1000
LEVEL = 6
MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
#: A record's own header may not be longer than this.
_HEADER = 1 << 16

_WRITTEN = "path string, bytes long, records long"
_READ = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _filesystem(uri: str):
    """The file system and the path in it of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _safe(value: str) -> str:
    """A header value without line ends or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of a response, or of a revisit that keeps the HTTP header but not the payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        # a task that is run again writes another file; only files of finished tasks are in the returned rows
        path = posixpath.join(root, f"part-{uuid.uuid4().hex}.warc.gz")
        stream, size, records = None, 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if stream is None:
                    stream = system.open_output_stream(path, compression=None)  # else the name would decide
                own = f"{_URN}{row.id}" if row.id is not None else f"urn:uuid:{uuid.uuid4()}"
                refers_to = f"{_URN}{row.refers_to}" if row.refers_to is not None else None
                member = gzip.compress(record(own, row.url, row.payload, row.digest, refers_to), LEVEL, mtime=0)
                stream.write(member)
                size, records = size + len(member), records + 1
        if stream is not None:
            stream.close()
            yield pd.DataFrame({"path": [f"{folder}/{posixpath.basename(path)}"], "bytes": [size], "records": [records]})

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row to files in a shared folder; returns the files, `path, bytes, records`.

    The payload is the html in UTF-8. Of rows with equal payloads (by SHA-1) of `LEAST_REVISITED` bytes or more, the
    one with the largest id is a response and the others revisit it; rows that share that id all are responses.
    Other rows are responses. A null html is an empty payload, a null url gives no target, a row with a null id
    is a response under a random record id. With no rows there are no files.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.octet_length("payload") >= LEAST_REVISITED) & F.col("id").isNotNull())
    groups = large.groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers_to = F.when(F.col("id") != F.col("target"), F.col("target")).cast("string").alias("refers_to")
    planned = ready(rows).join(groups, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers_to)
    return stored(planned.mapInPandas(_writer(folder), _WRITTEN), "warc-files")


class _Bytes:
    """A file read in blocks; only what lies at or after the last `since` is kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def since(self, at: int) -> None:
        if at < self.start or at > self.start + len(self.data):
            self.start, self.data = at, b""
        elif at - self.start >= BLOCK:
            self.start, self.data = at, self.data[at - self.start :]

    def block(self, at: int) -> bytes:
        """Some bytes from `at` on; none at the end of the file."""
        end = self.start + len(self.data)
        if at >= end and end < self.size:
            self.data += self.file.read_at(min(BLOCK, self.size - end), end)
        return self.data[at - self.start :]

    def find(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on, or -1."""
        while True:
            self.since(at)
            data = self.block(at)
            if len(data) < len(what) and at + len(data) < self.size:
                more = self.file.read_at(min(BLOCK, self.size - at - len(data)), at + len(data))
                self.start, self.data = at, data + more
                data = self.data
            found = data.find(what)
            if found >= 0:
                return at + found
            if at + len(data) >= self.size:
                return -1
            at += max(len(data) - len(what) + 1, 1)


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and where it ends; None if it is no member holding a WARC record."""
    decoder, parts, place, head = zlib.decompressobj(31), [], at, b""
    try:
        while not decoder.eof:
            data = source.block(place)
            if not data:
                return None
            parts.append(decoder.decompress(data))
            place += len(data)
            if len(head) < 7:
                head += parts[-1][:7]
                if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    content = b"".join(parts)
    if not content.startswith(b"WARC/1.") or content.find(b"\r\n\r\n", 0, _HEADER) < 0:
        return None
    return content, place - len(decoder.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a member: header fields and block."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.index(b"\r\n\r\n", at)
        fields = _fields(content[at:end])
        start, size = end + 4, int(fields["content-length"])
        if start + size > len(content):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, content[start : start + size]
        at = start + size + 4


def _parsed(path: str, offset: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(head).get("content-length", len(payload)))
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32decode(digest).hex() if digest else None
    if kind == "response" and digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} in {path} at {offset} doesn't match its digest")
    plain = {name: fields[name].strip("<>") for name in ("warc-record-id", "warc-refers-to") if name in fields}
    kept = payload if payloads and kind != "revisit" else None
    return path, offset, kind, plain.get("warc-record-id"), fields.get("warc-target-uri"), plain.get("warc-refers-to"), digest, size, kept


def records_between(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that start in [start, end), wherever they end."""
    source, at = _Bytes(file, size), start
    while at < end:
        at = source.find(MAGIC, at)
        if at < 0 or at >= end:
            return
        found = _member(source, at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def _reader(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"].tolist(), batch["start"].tolist()):
                system, inside = _filesystem(path)
                rows, held = [], 0
                with system.open_input_file(inside) as file:
                    for offset, content in records_between(file, size, start, min(start + SPLIT, size)):
                        rows += [_parsed(path, offset, *r, payloads) for r in _records(content)]
                        held += len(content) if payloads else 200
                        if held > BLOCK:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of gzipped WARC files (`path, bytes`), one row each, with the columns of `_READ`.

    Files are cut every `SPLIT` bytes. A task looks for the gzip magic from the start of its range on; a candidate is
    a record if it decodes, to the checksum at its end, to content that begins as a WARC header. Records that start inside the
    range are the task's own, also where they end beyond it, and the search goes on behind each. Payloads of
    responses are held against their digests; a mismatch is an error. Revisits have the size of the full payload and no
    bytes of it. The one limit: an archive stored uncompressed within a record, at the very start of a range,
    would pass for records; `write_archives` compresses every member.
    """
    starts = files.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {SPLIT}L)")).alias("start"))
    n = starts.count()
    return ready(starts).repartition(max(n, 1)).mapInPandas(_reader(payloads), _READ)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    system, root = _filesystem(folder)
    system.create_dir(root)
    return folder


def page_id(record_id):
    """The page id in a record id; null for a record of a page without one."""
    return F.regexp_extract(record_id, f"^{_URN}(-?[0-9]+)$", 1).try_cast("long")
