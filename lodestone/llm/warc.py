"""WARC archives: written by Spark's tasks, and read back by a reader that salvages what a damaged archive still holds.

The writer stores each payload once and lets later pages of the same payload revisit it. The reader checks every record:
the compressed member's checksum, the version line, the header fields, the block's length and its digests. After a failed
check it looks for the next member or version line from which a whole record can be read, goes on there, and logs the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Payloads of fewer bytes are stored each time.
LEAST = 100
#: Compressed bytes after which a task begins its next archive: the reader's tasks read whole archives.
ARCHIVE = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A payload that more than one in so many repeated pages holds is common: fewer than this many, broadcast.
SHARE = 1000
#: Bytes that the reader fetches at a time, and the most that a record's header may have.
FETCH, HEADER = 1 << 18, 1 << 20

_MANIFEST = "path string, n_records long, n_bytes long"
SCHEMA = (
    "path string, start long, stop long, error string, type string, record_id string, uri string, page_id long, refers_to long,"
    " refers_to_record string, payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]


# Writing


def _storage(folder: str):
    """The file system of a folder that driver and executors share, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str) -> str:
    """The URL with control characters and spaces escaped, so that it fits a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    """One record as bytes; fields that are null are left out."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **fields}
    lines |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}
    head = "".join(f"{name}: {value}\r\n" for name, value in lines.items() if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, least: int | None) -> bytes:
    """A page's response, or without ``payload`` its revisit of page ``least``. Both hold the page's HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = {"WARC-Target-URI": None if url is None else _uri(url), "Page-Id": page_id, "WARC-Payload-Digest": f"sha256:{digest}"}
    if payload is None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(least, digest), "Refers-To-Page-Id": least}
    fields["Content-Type"] = "application/http; msgtype=response"
    return record("response" if payload is not None else "revisit", _record_id(page_id, digest), fields, http + (payload or b""))


def _written(batches, folder: str, size: int):
    """Archives of one compressed member a record, and a row for each. A task that is run again writes archives of other
    names; what is read are those in the rows of the run that Spark has committed."""
    storage, place = _storage(folder)
    storage.create_dir(place, recursive=True)
    stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    out, rows, n_records, n_bytes = None, [], 0, 0

    def put(data: bytes) -> None:
        nonlocal n_records, n_bytes
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(data) + packer.flush()
        out.write(data)
        n_records, n_bytes = n_records + 1, n_bytes + len(data)

    def close() -> None:
        if out is not None:
            out.close()
            rows.append((f"{folder}/{name}", n_records, n_bytes))

    for batch in batches:
        for page_id, url, html, digest, length, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None or n_bytes > size:
                close()
                name, n_records, n_bytes = f"pages-{stem}-{len(rows):04d}.warc.gz", 0, 0
                out = storage.open_output_stream(f"{place}/{name}", compression=None)
                put(record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n"))
            put(page_record(page_id, url, None if html is None else html.encode(), digest, length, least))
    close()
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (null for revisits), digest, n_bytes and least: the page that a revisit refers to, else null.

    Of pages with equal payloads of ``least`` bytes or more, the smallest page_id responds; rows that repeat it respond too, as
    nothing tells them apart. Null ids come last: they revisit, unless all pages of the payload have none. Common payloads
    are looked up where their pages are and send no text; the others are shuffled by digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    held = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    held = materialize(held.where("n > 1 AND least IS NOT NULL"), "payloads")
    total = held.agg(F.sum("n")).first()[0] or 0
    common = held.where(F.col("n") > total // SHARE)
    rows = rows.join(F.broadcast(common.select("digest", F.col("least").alias("here"))), "digest", "left")
    text = F.when(F.col("here").isNull() | F.col("page_id").eqNullSafe(F.col("here")), F.col("html"))
    # A common payload needs no partner any more: its pages go anywhere.
    place = F.when(F.col("here").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.lit(0)), F.coalesce("url", F.lit(""))))
    rare = held.where(F.col("n") <= total // SHARE).select(F.col("digest").alias("place"), F.col("least").alias("there"))
    rows = rows.select("page_id", "url", text.alias("html"), "digest", "n_bytes", "here", place.alias("place")).join(rare, "place", "left")
    least_id = F.coalesce("here", "there")
    revisits = least_id.isNotNull() & ~F.col("page_id").eqNullSafe(least_id)
    return rows.select("page_id", "url", F.when(~revisits, F.col("html")).alias("html"), "digest", "n_bytes", F.when(revisits, least_id).alias("least"))


def write_archives(pages: DataFrame, folder: str | None = None, size: int = ARCHIVE, least: int = LEAST) -> DataFrame:
    """Write a record for each page to archives in ``folder``, a new one in the shared folder where none is given.

    Returns path, n_records (a warcinfo record each included) and n_bytes of every archive. Payload is the whole html in UTF-8,
    empty where it is null. Null urls and ids leave their header out; further columns are ignored; an empty table
    gives no archive. Which page responds: ``roles``.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return materialize(roles(pages, least).mapInArrow(lambda batches: _written(batches, folder, size), _MANIFEST), "archives")


# Reading


class Damaged(ValueError):
    """A check has failed."""


class Bytes:
    """A file's bytes by place, fetched in blocks of which the last one stays."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.block = 0, b""

    def read(self, start: int, length: int) -> bytes:
        """``length`` bytes from ``start`` on, fewer only at the end."""
        stop = min(start + length, self.size)
        if start >= stop:
            return b""
        if not (self.at <= start and stop <= self.at + len(self.block)):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(max(stop - start, FETCH))
        return self.block[start - self.at : stop - self.at]


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of equal names; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, value.strip())
        elif line:
            raise Damaged("header line without a name")
    return out


def _check_digest(what: str, stated: str | None, data: bytes) -> None:
    """Digests of known algorithms hold, in hexadecimal or base 32; others are not judged."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower().replace("-", "") in ("sha1", "sha256", "sha512", "md5"):
        found = hashlib.new(algorithm.lower().replace("-", ""), data)
        if value.lower() != found.hexdigest() and value.upper().rstrip("=") != base64.b32encode(found.digest()).decode().rstrip("="):
            raise Damaged(f"{what} digest differs")


def _head(data: bytes) -> tuple[dict[str, str], int, int]:
    """The fields at the start of ``data``, where the block begins and how long it is."""
    if not re.match(rb"WARC/\d\.\d\r\n", data):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", 0, HEADER)
    if stop < 0:
        raise Damaged("header does not end")
    fields = _fields(data[data.index(b"\r\n") + 2 : stop])
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Damaged("header lacks a length or a type")
    return fields, stop + 4, int(fields["content-length"])


def _read_record(fields: dict[str, str], block: bytes) -> dict[str, object]:
    """What a row has of a record whose framing holds."""
    _check_digest("block", fields.get("warc-block-digest"), block)
    kind, payload, http = fields["warc-type"].lower(), block, {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, between, payload = block.partition(b"\r\n\r\n")
        if not between:
            raise Damaged("HTTP header does not end")
        http = _fields(head.partition(b"\r\n")[2])
    stated = fields.get("warc-payload-digest")
    digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
    if kind == "revisit":
        # The payload is the other record's; its digest and length are stated here.
        algorithm, _, value = (stated or "").partition(":")
        digest = value.lower() if algorithm.lower() in ("sha256", "sha-256") and len(value) == 64 else None
        length = int(http["content-length"]) if re.fullmatch(r"\d{1,18}", http.get("content-length", "")) else None
    else:
        _check_digest("payload", stated, payload)
    number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d{1,19}", fields.get(name, "")) and -(1 << 63) <= int(fields[name]) < 1 << 63 else None
    return {
        "type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "page_id": number("page-id"), "refers_to": number("refers-to-page-id"),
        "refers_to_record": fields.get("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload,
    }


def _member(data: Bytes, start: int) -> tuple[int, list[dict[str, object]]]:
    """The records of the compressed member at ``start``, usually one, and where it ends."""
    unpack, parts, at = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            piece = data.read(at, FETCH)
            if not piece:
                raise Damaged("member does not end")
            at += len(piece)
            parts.append(unpack.decompress(piece))
    except zlib.error as fault:
        raise Damaged(f"member: {fault}") from fault
    whole, found, place = b"".join(parts), [], 0
    while place < len(whole) or not found:
        fields, begin, length = _head(whole[place:] if place else whole)
        stop = place + begin + length
        if whole[stop : stop + 4] != b"\r\n\r\n":
            raise Damaged("block's length differs")
        found.append(_read_record(fields, whole[place + begin : stop]))
        place = stop + 4
    return at - len(unpack.unused_data), found


def _plain(data: Bytes, start: int) -> tuple[int, list[dict[str, object]]]:
    """The uncompressed record at ``start`` and where it ends."""
    size = FETCH
    while b"\r\n\r\n" not in (head := data.read(start, size)) and len(head) == size < HEADER:
        size *= 2
    fields, begin, length = _head(head)
    stop = start + begin + length
    if data.read(stop, 4) != b"\r\n\r\n":
        raise Damaged("block's length differs")
    return stop + 4, [_read_record(fields, data.read(start + begin, length))]


def _next(data: Bytes, start: int, packed: bool) -> int:
    """The first place from ``start`` on where a member of a record, or a version line, may begin; the end if none does."""
    sought = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]" if packed else rb"WARC/\d\.\d\r\n")
    while start < data.size:
        block = data.read(start, FETCH)
        for m in sought.finditer(block):
            if not packed:
                return start + m.start()
            try:
                if zlib.decompressobj(31).decompress(data.read(start + m.start(), 4096), 5) == b"WARC/":
                    return start + m.start()
            except zlib.error:
                pass
            if not data.at <= start < data.at + len(data.block):
                data.read(start, len(block))
        start += max(1, len(block) - 9) if len(block) == FETCH else len(block)
    return data.size


def salvage(file, packed: bool | None = None):
    """(start, stop, error, record) over the whole of a seekable ``file``, in order and without overlap or hole: records with no
    error, and gaps with no record, each from the first failed check to the next record that can be read whole.

    ``packed``: whether records are compressed members; where it is null, the first two bytes tell. A text inside a
    damaged plain record that looks like a whole record is read as one. One record at a time is held in memory.
    """
    data = Bytes(file)
    packed = data.read(0, 2) == b"\x1f\x8b" if packed is None else packed
    at, gap, why = 0, None, ""
    while at < data.size:
        try:
            stop, found = (_member if packed else _plain)(data, at)
        except Damaged as fault:
            if gap is None:
                gap, why = at, str(fault)
            at = _next(data, at + 1, packed)
            continue
        if gap is not None:
            yield gap, at, why, None
            gap = None
        for one in found:
            yield at, stop, None, one
        at = stop
    if gap is not None:
        yield gap, data.size, why, None


def _read(batches, payloads: bool):
    rows: list[list] = []
    held = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    for given in batches:
        for path in given.column("path").to_pylist():
            storage, place = _storage(path)
            try:
                file = storage.open_input_file(place)
            except OSError as fault:
                rows.append([path, None, None, f"cannot be opened: {type(fault).__name__}", *[None] * 9])
                continue
            with file:
                for start, stop, error, one in salvage(file, True if place.endswith(".gz") else None):
                    one = one or {}
                    if not payloads:
                        one["payload"] = None
                    rows.append([path, start, stop, error, *(one.get(name) for name in _NAMES[4:])])
                    held += len(one.get("payload") or b"") + 300
                    if held > 4 << 20:
                        yield batch()
                        held = 0
    yield batch()


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named in ``path``, and their gaps: columns of ``SCHEMA``.

    A record has its place in bytes (start, stop) and no error; a gap has its place and, in error, the check that failed
    first. An archive that cannot be opened is a row with an error and no place. Null paths are ignored, a path given
    twice is read twice, no archives give no rows. payload_bytes and payload_digest (SHA-256) are computed from what is read; for
    revisits they are as stated. ``payloads`` keeps the payloads themselves. An archive is read by one task, a record at a time.
    """
    paths = archives.select(F.col("path").cast("string").alias("path")).where("path IS NOT NULL")
    # Archives are few and listed in a small table: each is a task's work.
    return paths.repartition(max(1, min(paths.count(), 1 << 14))).mapInArrow(lambda batches: _read(batches, payloads), SCHEMA)


def gaps(records: DataFrame) -> DataFrame:
    """The quarantined ranges of bytes: path, start, stop, error."""
    return records.where(F.col("error").isNotNull()).select("path", "start", "stop", "error")


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits whose response is not among ``records``, as when it lies in a gap: record_id, page_id, refers_to_record."""
    there = records.where("error IS NULL AND type = 'response'").select(F.col("record_id").alias("refers_to_record"))
    revisits = records.where("error IS NULL AND type = 'revisit'")
    wanted = revisits.select("refers_to_record").where("refers_to_record IS NOT NULL").distinct()
    missing = wanted.join(there, "refers_to_record", "left_anti")
    found = revisits.select("record_id", "page_id", "refers_to_record")
    return found.join(missing, "refers_to_record").unionByName(found.where("refers_to_record IS NULL"))


def page_records(records: DataFrame) -> DataFrame:
    """Per page that is read: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = records.where("error IS NULL AND type IN ('response', 'revisit')")
    return pages.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
