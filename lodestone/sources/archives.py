"""Zip archives of any size: the list of entries is read first, then the entries are dealt out by where they lie.

An archive is never a row. One task reads its central directory, at its end, and lists the entries; these go by place to as many
tasks as their bytes need, each of which opens the archive where its entries begin and unpacks one at a time.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import MOST_SOURCE_BYTES, is_readable, is_skipped, looks_minified, strip_common_root

#: Packed bytes that a task reads.
SHARE = 64 << 20

_ENTRY = "corpus string, archive string, path string, offset long, packed long, bytes long, method int, flags int, crc long, error string"
_NAMES = [part.split()[0] for part in _ENTRY.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[part.split()[1]] for part in _ENTRY.split(", ")]
_TEXT = "corpus string, archive string, path string, src string, error string"
_LOCAL = struct.Struct("<4s5H3L2H")


def _open(path: str):
    from pyarrow import fs

    storage, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return storage.open_input_file(place)


class _Raw(io.RawIOBase):
    """An Arrow file that answers a place before its beginning as other files do, which the reader of short archives relies on."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, place: int, whence: int = 0) -> int:
        at = place + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the beginning")
        return self.file.seek(at)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _listed(batches):
    for batch in batches:
        rows: list[tuple] = []
        for corpus, archive in zip(batch.column("corpus").to_pylist(), batch.column("archive").to_pylist(), strict=True):
            try:
                with _open(archive) as file, zipfile.ZipFile(io.BufferedReader(_Raw(file))) as packed:
                    rows += [
                        (corpus, archive, e.filename, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.flag_bits, e.CRC, None)
                        for e in packed.infolist() if not e.is_dir()
                    ]
            except (OSError, zipfile.BadZipFile, ValueError, NotImplementedError) as fault:
                rows.append((corpus, archive, *[None] * 7, f"no archive: {type(fault).__name__}"))
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def entries(archives: DataFrame) -> DataFrame:
    """Every file in archives(corpus, archive), archive being a path: its name in the archive, where it begins, how many bytes it has
    packed and unpacked. An archive whose list cannot be read is one row with an error. Directories are no entries."""
    paths = archives.select("corpus", "archive").where("archive IS NOT NULL")
    return paths.repartition(max(1, min(paths.count(), 1 << 14))).mapInArrow(_listed, _ENTRY)


def _unpacked(file, offset: int, packed: int, size: int, method: int, flags: int, crc: int) -> tuple[str | None, str | None]:
    """The text of an entry, or what is wrong with it."""
    if flags & 1:
        return None, "encrypted"
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, f"packed by method {method}"
    file.seek(offset)
    head = file.read(_LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
        return None, "no entry where the list says"
    name, extra = _LOCAL.unpack(head)[-2:]
    file.seek(offset + _LOCAL.size + name + extra)
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, size + 1)
        except zlib.error:
            return None, "damaged"
    if len(data) != size or zlib.crc32(data) != crc:
        return None, "damaged"
    return data.decode("utf-8", "replace"), None


def _texts(batches):
    archive, file = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    if file is not None:
                        file.close()
                    archive, file = row["archive"], _open(row["archive"])
                src, error = _unpacked(file, *(row[c] for c in ("offset", "packed", "bytes", "method", "flags", "crc")))
                values = (row["corpus"], archive, row["path"], src, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in values], [part.split()[0] for part in _TEXT.split(", ")])
    finally:
        if file is not None:
            file.close()


def read_archives(archives: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(files, bad): files(corpus, path, src) as ``ingest.read_zips`` gives them, and what could not be read: (corpus, archive, path,
    error), an archive without a list among it.

    Entries are chosen by name and size before any is unpacked, then dealt out by ranges of their place, so that a task reads about
    ``share`` bytes and holds one entry, which MOST_SOURCE_BYTES bounds. An archive listed twice is read twice; null paths are
    ignored; an empty table gives no rows.
    """
    listed = entries(archives)
    wanted = listed.where(F.col("error").isNull() & is_readable() & ~is_skipped() & (F.col("bytes") <= MOST_SOURCE_BYTES) & (F.col("path") != ""))
    total = wanted.agg(F.sum("packed")).first()[0] or 0
    dealt = wanted.repartitionByRange(total // share + 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    texts = dealt.mapInArrow(_texts, _TEXT)
    none = listed.where(F.col("error").isNotNull()).select("corpus", "archive", F.lit(None).cast("string").alias("path"), "error")
    bad = none.unionByName(texts.where(F.col("error").isNotNull()).select("corpus", "archive", "path", "error"))
    files = strip_common_root(texts.where(F.col("error").isNull()).select("corpus", "path", "src"))
    return files.where(~looks_minified()), bad
