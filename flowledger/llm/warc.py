"""WARC archives: a writer that rolls gzip-per-record files and a reader that salvages damaged ones.

The reader checks each record (member checksum, version line, Content-Length, block digest, closing
line ends). After a failed check it looks for the next offset at which a gzip member that holds a version
line, or a version line, begins, goes on from there and reports the bytes in between as a gap, so later
records are recovered and nothing is lost silently. An archive may mix plain records and members, and a
member may hold any number of records; within its data the search for version lines is the same. Of a
damaged member those records are kept that stand before the damage and whose block digest holds.

Defined results: a null payload is empty; a null id or URI is left out of the record and read back as
null; line ends in a URI are percent-encoded; repeated rows give a record each (rows that share the
smallest id of a payload are all responses); an empty table gives no archives and no records. Further
columns of the input are ignored. A plain record or a member is held in memory whole, an archive never is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

#: Payloads below so many bytes are always stored.
LEAST_REVISIT = 100
ROLL_BYTES = 32 << 20
CHUNK = 256 << 10
STEP = 4096
ID_PREFIX = "urn:x-page:"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, "
    "refers_to string, declared_digest string, declared_length long, payload binary, inner long, inner_length long"
)
#: Where a record can begin. A line of a plain record and the magic number of a member.
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
LONGEST_START = 10


# -- writing ---------------------------------------------------------------------------------------


def _identifier(value) -> str:
    return f"<{ID_PREFIX}{value}>"


def format_record(record_id, uri, payload: bytes, digest: str, first) -> bytes:
    """One record; a revisit of ``first`` keeps the HTTP head, with the payload's length, but no payload."""
    revisit = first is not None
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: {_identifier(record_id)}")
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += [f"WARC-Refers-To: {_identifier(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest and ``first``: the smallest page_id with an equal payload, for all rows but its own.

    Only payloads met more than once are joined back, each to one row, so a hot payload is a split side.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(uri).cast("string").alias("url"),
        body.alias("html"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"),
        F.octet_length(body).alias("size"),
    )
    firsts = (
        rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )


def write_archives(marked: DataFrame, folder: str, compress: bool = True, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of :func:`mark_revisits` as archives under ``folder``, which all executors reach.

    Gives the manifest (path, records, bytes). Names hold the task attempt, so a repeated task writes new
    files and only those in the manifest count; store the manifest before reading it more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, records, size, files = None, "", 0, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                page, uri, html, digest, first = (x.as_py() for x in row)
                data = format_record(page, uri, html.encode(), digest, first)
                data = _member(data) if compress else data
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files:05d}.warc" + ".gz" * compress
                    path, records, size, files = f"{folder}/{name}", 0, 0, files + 1
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return marked.mapInArrow(run, MANIFEST)


# -- reading ---------------------------------------------------------------------------------------


class Damaged(Exception):
    """A record failed a check."""


class _Source:
    """Random reads from an open file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(max(0, min(size, self.size - offset)))

    def find(self, pattern: bytes, start: int, most: int) -> int:
        """Offset of the next ``pattern`` within about ``most`` bytes, or the end."""
        last = start + most
        while start < self.size and start <= last:
            data = self.at(start, CHUNK + len(pattern) - 1)
            if (i := data.find(pattern)) >= 0:
                return start + i
            start += CHUNK
        return self.size


def _inflate(source: _Source, offset: int, most: int | None = None) -> tuple[bytes, int, str | None, list[tuple[int, int]]]:
    """Data of the member at ``offset`` as far as it can be read, its compressed length, what is wrong with it, and (data, offset) where each step began.

    With ``most``, so many bytes of the data, unchecked.
    """
    unpacker, parts, got, at, damage, steps = zlib.decompressobj(31), [], 0, offset, None, []
    while not unpacker.eof and damage is None and (most is None or got < most):
        # small steps, since what a step gave before an error in it is lost
        data = source.at(at, STEP)
        if not data:
            damage = "member cut off"
            break
        steps.append((got, at))
        at += len(data)
        try:
            parts.append(unpacker.decompress(data) if most is None else unpacker.decompress(data, most - got))
            got += len(parts[-1])
        except zlib.error as e:
            damage = f"member: {e}"
    return b"".join(parts), at - offset - len(unpacker.unused_data), damage, steps


def _headers(data: bytes) -> dict[str, str]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise Damaged("no version line")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _record(head: dict[str, str], block: bytes) -> dict:
    declared = head.get("warc-block-digest", "")
    if declared.startswith("sha256:") and hashlib.sha256(block).hexdigest() != declared[7:]:
        raise Damaged("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    strip = lambda k: (v := head.get(k)) and v.strip("<>").removeprefix(ID_PREFIX)
    return {
        "record_type": head.get("warc-type"),
        "record_id": strip("warc-record-id"),
        "target_uri": head.get("warc-target-uri"),
        "refers_to": strip("warc-refers-to"),
        "declared_digest": (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
        "declared_length": int(length[1]) if length else None,
        "payload": payload,
    }


def _content_length(head: dict[str, str]) -> int:
    if not (n := head.get("content-length", "")).isdigit():
        raise Damaged("no length")
    return int(n)


def _member_rows(data: bytes, whole: bool) -> Iterator[dict]:
    """Records and gaps in the data of a member, by place; of a damaged member only what a block digest vouches for."""
    at = 0
    while at < len(data):
        try:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                raise Damaged("head cut off")
            head = _headers(data[at:end])
            start, n = end + 4, _content_length(head)
            if data[start + n : start + n + 4] != b"\r\n\r\n":
                raise Damaged("length differs")
            if not whole and not head.get("warc-block-digest", "").startswith("sha256:"):
                raise Damaged("in a damaged member, without digest")
            yield {"inner": at, "inner_length": start + n + 4 - at, "gap": None} | _record(head, data[start : start + n])
            at = start + n + 4
        except Damaged as e:
            found = VERSION_LINE.search(data, at + 1)
            to = found.start() if found else len(data)
            yield {"inner": at, "inner_length": to - at, "gap": str(e)}
            at = to


def _read_member(source: _Source, offset: int) -> Iterator[dict]:
    """The rows of the member at ``offset``. All tell its place; only the first counts its bytes."""
    data, length, damage, steps = _inflate(source, offset)
    rows = list(_member_rows(data, damage is None))
    if damage:
        # the bytes up to the last record that holds are this member's for certain
        rows = [r for r in rows if not r["gap"]]
        sure = max((r["inner"] + r["inner_length"] for r in rows), default=0)
        length = _next_start(source, max((at for got, at in steps if got <= sure), default=offset)) - offset
        rows.append({"inner": None, "inner_length": None, "gap": damage})
    elif not rows:
        rows = [{"inner": 0, "inner_length": 0, "gap": "empty member"}]
    for i, row in enumerate(rows):
        yield {"offset": offset, "length": 0 if i else length} | row


def _read_plain(source: _Source, offset: int) -> Iterator[dict]:
    """The record whose version line stands at ``offset``."""
    end = source.find(b"\r\n\r\n", offset, 4 * CHUNK)
    if end == source.size or end - offset > 4 * CHUNK:
        raise Damaged("head cut off")
    head = _headers(source.at(offset, end - offset))
    start, n = end + 4, _content_length(head)
    if start + n + 4 > source.size or source.at(start + n, 4) != b"\r\n\r\n":
        raise Damaged("length differs")
    yield {"offset": offset, "length": start + n + 4 - offset, "gap": None, "inner": None, "inner_length": None} | _record(head, source.at(start, n))


def _next_start(source: _Source, offset: int) -> int:
    """The next offset after ``offset`` at which a version line, or a member that holds one, begins; else the end."""
    at = offset + 1
    while at < source.size:
        data = source.at(at, CHUNK + LONGEST_START - 1)
        for found in START.finditer(data):
            start = at + found.start()
            if found[0] != MEMBER or VERSION_LINE.match(_inflate(source, start, LONGEST_START)[0]):
                return start
        at += CHUNK
    return source.size


def salvage(file) -> Iterator[dict]:
    """Records and gaps of an open archive, in order; the lengths of all cover every byte once."""
    source, offset = _Source(file), 0
    while offset < source.size:
        try:
            if source.at(offset, 3) == MEMBER:
                rows = _read_member(source, offset)
            else:
                rows = _read_plain(source, offset)
            row = next(rows)
        except Damaged as e:
            length = _next_start(source, offset) - offset
            row, rows = {"offset": offset, "length": length, "gap": str(e)}, iter(())
        yield row
        yield from rows
        offset += row["length"]


def read_archives(paths: DataFrame) -> DataFrame:
    """Every record and gap of the archives in column ``path``; ``gap`` is the failed check, null for records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["path", "offset", "length", "gap", "record_type", "record_id", "target_uri", "refers_to", "declared_digest", "declared_length", "payload", "inner", "inner_length"]
        kinds = {"offset": pa.int64(), "length": pa.int64(), "declared_length": pa.int64(), "payload": pa.binary(), "inner": pa.int64(), "inner_length": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    for row in salvage(file):
                        rows.append({"path": path} | row)
                        size += 200 + len(row.get("payload") or b"")
                        if size > 8 << 20 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select("path").mapInArrow(run, RECORDS)


def quarantine(read: DataFrame) -> DataFrame:
    """The byte ranges that held no valid record, with the reason; ``inner`` and ``inner_length`` are the range in the data of a valid member."""
    return read.filter(F.col("gap").isNotNull()).select("path", "offset", "length", "inner", "inner_length", F.col("gap").alias("reason"))


def page_records(read: DataFrame) -> DataFrame:
    """Per record that was read: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    revisit = F.col("record_type") == "revisit"
    return read.filter(F.col("gap").isNull()).select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("declared_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to").cast("long")).alias("refers_to"),
    )
