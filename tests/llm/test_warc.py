"""Archives: round trips, and salvage of damaged ones."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import pytest

from lodestone.llm import warc


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def brute(rows, least=100):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        again = to is not None and i != to
        out[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None] += 1
    return out


def pages_of(spark, rows, parts=3):
    full = [("x", i, u, 5, h, "d", 1) for i, u, h in rows]
    return spark.createDataFrame(full, "digest string, page_id long, url string, n_bytes long, html string, place string, least long").repartition(parts)


def same(spark, rows, **options):
    records = warc.read_archives(warc.write_archives(pages_of(spark, rows), **options))
    assert warc.gaps(records).count() == 0 and warc.unresolved(records).count() == 0
    assert Counter(tuple(r) for r in warc.page_records(records).collect()) == brute(rows)


ROWS = [
    (1, "http://a/", "x" * 100), (2, "http://b/", "x" * 100), (3, None, "x" * 99), (4, "u\r\nWARC/1.1 é", "x" * 99), (5, "", None), (6, "http://c/", ""), (7, "h", "é" * 50),
    (None, "n", "é" * 50), (0, "z", "é" * 50), (0, "z", "é" * 50), (None, "m", "only null ids " * 9), (None, "m", "only null ids " * 9), (9, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5),
    (10, "w", "\r\n\r\n" * 40), (-3, "neg", "\r\n\r\n" * 40),
]


def test_round_trip_of_odd_pages(spark):
    same(spark, ROWS)
    same(spark, [(i, f"h{i % 3}", "hot page " * 40 if i % 3 else f"page {i // 2} " * 30) for i in range(400)], size=2000)
    same(spark, [(1, "u", "long \x00 page " * 300_000), (2, "v", "long \x00 page " * 300_000)])
    none = warc.read_archives(warc.write_archives(pages_of(spark, ROWS).where("false")))
    assert warc.page_records(none).count() == 0 and none.columns == warc._NAMES


def test_common_and_rare_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARE", 3)
    same(spark, [(i, f"h{i % 3}", "hot page " * 40 if i % 3 else f"page {i // 6} " * 30) for i in range(200)])


def test_table(spark, table):
    df = table("pages")
    records = warc.read_archives(warc.write_archives(df), payloads=True)
    assert Counter(tuple(r) for r in warc.page_records(records).collect()) == brute([tuple(r) for r in df.select("page_id", "url", "html").collect()])
    read = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("type = 'response'").collect()}
    assert all(read[r["page_id"]] == (r["html"] or "") for r in df.collect() if r["page_id"] in read)


def archive(n, packed, rng):
    parts = []
    for i in range(n):
        payload = rng.choice([b"", b"plain text " * rng.randrange(1, 40), rng.randbytes(rng.randrange(900))])
        one = warc.page_record(i, f"http://host/{i}", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)
        parts.append(gzip.compress(one, mtime=0) if packed else one)
    return parts


def scan(data, packed=None):
    rows = list(warc.salvage(File(data), packed))
    at = 0
    for (start, stop, error, one), before in zip(rows, [None, *rows], strict=False):
        assert start == at and stop > start and (error is None) == (one is not None)
        assert not (error and before and before[2]), "gaps do not touch"
        at = stop
    assert at == len(data)
    return {one["page_id"]: (start, stop) for start, stop, _, one in rows if one}, [(start, stop) for start, stop, error, _ in rows if error]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed, monkeypatch):
    monkeypatch.setattr(warc, "FETCH", 512)
    rng = random.Random(packed)
    for turn in range(150):
        parts = archive(rng.randrange(1, 9), packed, rng)
        places, at = [], 0
        for p in parts:
            places.append((at, at + len(p)))
            at += len(p)
        data = bytearray(b"".join(parts))
        hurt = set()
        if turn % 5:
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(parts))
                lo, hi = places[k]
                # In a packed member a few bits of the header (time, operating system) are checked by nothing.
                x = rng.randrange(lo + (10 if packed else 0), hi)
                data[x] ^= 1 << rng.randrange(8)
                hurt.add(k)
        found = {(start, stop): one and one["page_id"] for start, stop, _, one in warc.salvage(File(bytes(data)), packed)}
        lost = scan(bytes(data), packed)[1]
        for k, place in enumerate(places):
            if k in hurt:  # a changed field of a plain record, say its page's id, is not noticed
                assert (place in found and not packed) or any(lo <= place[0] and place[1] <= hi for lo, hi in lost)
            else:
                assert found.get(place) == k, "what is whole is read where it is"


def test_salvage_of_cuts_holes_and_filling():
    rng = random.Random(9)
    for packed in (True, False):
        parts = archive(6, packed, rng)
        whole = b"".join(parts)
        assert set(scan(whole)[0]) == set(range(6)) and not scan(whole)[1]
        found, lost = scan(whole[:-5])
        assert set(found) == set(range(5)) and lost == [(len(whole) - len(parts[5]), len(whole) - 5)]
        found, lost = scan(parts[0] + b"\0" * 700 + parts[1] + parts[2][: len(parts[2]) // 2] + parts[3])
        assert set(found) == {0, 1, 3} and len(lost) == 2 and lost[0] == (len(parts[0]), len(parts[0]) + 700)
        found, lost = scan(b"junk" + whole[len(parts[0]) // 2 :], packed)
        assert set(found) == set(range(1, 6)) and len(lost) == 1
        assert scan(b"") == ({}, []) and scan(b"nothing here at all", packed) == ({}, [(0, 19)])
        assert set(scan(parts[0] + whole, packed)[0]) == set(range(6))
    # A member inside a stored member is not taken for one of the archive.
    inner = archive(1, True, rng)[0]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = warc.page_record(50, "u", inner, hashlib.sha256(inner).hexdigest(), len(inner), None)
    assert set(scan(stored.compress(outer) + stored.flush())[0]) == {50}


def test_foreign_records():
    payload = b"<p>text</p>"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(payload).digest()).decode()
    head = "WARC/1.0\r\nwarc-type: resource\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n"
    good = (head % (sha1, len(payload))).encode() + payload + b"\r\n\r\n"
    rows = list(warc.salvage(File(good * 2)))
    assert [r[3]["uri"] for r in rows] == ["http://a/ b"] * 2 and rows[0][3]["payload"] == payload
    bad = good.replace(b"text", b"TEXT", 1)
    assert [(r[2], r[3] is None) for r in warc.salvage(File(bad + good))] == [("payload digest differs", True), (None, False)]
    both = gzip.compress(good + good)
    assert len(list(warc.salvage(File(both)))) == 2, "one member may hold several records"


def test_damaged_archives_through_spark(spark, tmp_path):
    made = warc.write_archives(pages_of(spark, [(i, "u", f"page {i // 2} " * 40) for i in range(40)], 1), folder=str(tmp_path / "a"))
    (row,) = made.collect()
    rows = {r["page_id"]: r for r in warc.read_archives(made).where("page_id IS NOT NULL").collect()}
    data = bytearray(open(row["path"], "rb").read())
    assert len(data) == row["n_bytes"] and len(rows) == 40 and row["n_records"] == 41
    data[rows[10]["start"] + 40] ^= 255
    open(tmp_path / "b.warc.gz", "wb").write(data)
    given = spark.createDataFrame([(str(tmp_path / "b.warc.gz"),), (None,), (str(tmp_path / "no.warc.gz"),)], "path string")
    records = warc.read_archives(given)
    assert {r["page_id"] for r in warc.page_records(records).collect()} == set(range(40)) - {10}
    lost = {r["path"][-9:]: (r["start"], r["stop"]) for r in warc.gaps(records).collect()}
    assert lost == {"b.warc.gz": (rows[10]["start"], rows[10]["stop"]), "o.warc.gz": (None, None)}
    assert [r["page_id"] for r in warc.unresolved(records).collect()] == [11]
