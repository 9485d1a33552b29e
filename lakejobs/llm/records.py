"""WARC records as gzip members, and a reader of byte ranges of archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

MAGIC = b"\x1f\x8b\x08"
#: Bytes that are read from an archive at a time.
READ = 1 << 20
#: A member whose first bytes hold no complete header after this many is no record.
MAX_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with the payload, or a revisit with its headers only."""
    name = "" if page is None else page
    target = re.sub(r"[\x00-\x20\x7f]", lambda x: f"%{ord(x[0]):02X}", url or f"urn:page:{name}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parsed(raw: bytes) -> dict:
    """The fields of a whole record; ``intact`` tells whether a response fits its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, given = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    response = kind == "response"
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if response else None,
        "payload_bytes": len(payload) if response else int(_headers(http).get("content-length", 0)),
        "payload_digest": digest(payload) if response else given,
        "refers_to": _page(fields.get("warc-refers-to")),
        "intact": not response or digest(payload) == given,
    }


class Members:
    """The records of an open archive that start in a byte range."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def _chunks(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            piece = self.file.read_at(min(READ, self.size - at), at)
            if not piece:
                return
            yield piece
            at += len(piece)

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """(content, bytes taken) of the record at a place, or None if none starts there.

        The header is looked at first, so that a chance match costs little.
        """
        unpack, parts, taken, valid = zlib.decompressobj(31), [], 0, False
        try:
            for piece in self._chunks(at):
                taken += len(piece)
                parts.append(unpack.decompress(piece))
                if not valid:
                    begun = b"".join(parts)
                    parts = [begun]
                    if not begun.startswith(b"WARC/1."[: len(begun)]):
                        return None
                    valid = begun.startswith(b"WARC/1.") and b"\r\n\r\n" in begun
                    if not valid and len(begun) > MAX_HEADER:
                        return None
                if unpack.eof:
                    return (b"".join(parts), taken - len(unpack.unused_data)) if valid else None
        except zlib.error:
            return None
        return None

    def starting_in(self, start: int, end: int) -> Iterator[bytes]:
        at = start
        while at < end:
            window = self.file.read_at(min(READ + 2, self.size - at), at)
            found = window.find(MAGIC)
            if found < 0:
                # The last two bytes may begin a magic number.
                at += max(len(window) - 2, 1)
                continue
            at += found
            if at >= end:
                return
            member = self._member(at)
            if member is None:
                at += 1
            else:
                yield member[0]
                at += member[1]


def open_store(folder: str):
    """(file system, path) of a URI or an absolute path, as seen from any task."""
    return fs.FileSystem.from_uri(folder)


def archived(folder: str):
    """(page, url, html, refers_to, revisit) batches to (path, bytes, records): one archive a task.

    An archive is written under a name of the attempt and then moved, so a task
    that runs again, or twice, leaves one whole archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_store(folder)
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{final}.{task.taskAttemptId()}"
        size = n = 0
        out = None
        for batch in batches:
            for page, url, html, refers, revisit in zip(*(c for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                whole = record(page.as_py(), url.as_py(), html.as_py() or b"", refers.as_py(), revisit.as_py())
                out.write(whole)
                size += len(whole)
                n += 1
        if out is not None:
            out.close()
            store.move(draft, final)
            name = f"{folder.rstrip('/')}/part-{task.partitionId():06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

    return run


FIELDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
])
#: Bytes of payload in a batch of records, about.
BATCH = 4 << 20


def read_ranges(with_payload: bool):
    """(path, bytes, start, end) to the records that start in each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as file:
                    part, n = [], 0
                    for raw in Members(file, row["bytes"]).starting_in(row["start"], row["end"]):
                        fields = parsed(raw)
                        if not with_payload:
                            fields["payload"] = None
                        part.append(fields)
                        n += len(raw)
                        if n >= BATCH:
                            yield pa.RecordBatch.from_pylist(part, FIELDS)
                            part, n = [], 0
                    if part:
                        yield pa.RecordBatch.from_pylist(part, FIELDS)

    return run
