"""ZIP and WARC against the standard library, and the whole round trip."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from changelens.llm import warc


def test_our_zip_is_read_by_the_library():
    raw = b"".join(warc.zip_stored([("a/b.txt", [b"one", b"two"]), ("é", [])]))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == ["a/b.txt", "é"] and z.read("a/b.txt") == b"onetwo" and z.testzip() is None


@pytest.mark.parametrize("comment", [b"", b"x" * 500 + b"PK\x05\x06" + b"y" * 40])
@pytest.mark.parametrize("zip64", [False, True])
def test_the_librarys_zip_is_read_by_ours(comment, zip64):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        with z.open("big.bin", "w", force_zip64=zip64) as f:
            f.write(b"payload" * 9)
        z.writestr(zipfile.ZipInfo("deflated"), b"x" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    raw = buf.getvalue()
    f = io.BytesIO(raw)
    members = {m.name: m for m in warc.central_directory(f, len(raw))}
    m = members["big.bin"]
    at = warc.stored_at(f, m)
    assert raw[at : at + m.size] == b"payload" * 9 and m.full == 63
    with pytest.raises(ValueError):
        warc.stored_at(f, members["deflated"])


def test_zip64_places_come_from_the_extra_field():
    raw = b"".join(warc.zip_stored([("m", [b"x" * 10])]))
    f = io.BytesIO(raw)
    (m,) = warc.central_directory(f, len(raw))
    assert (m.size, m.full, m.header) == (10, 10, 0)
    for broken in (raw[:-30], b"", raw[:40]):
        with pytest.raises(ValueError):
            warc.central_directory(io.BytesIO(broken), len(broken))


def expected(rows):
    best = {}
    pay = lambda h: (h or "").encode()
    for i, _, h in rows:
        if i is not None:
            best[pay(h)] = max(i, best.get(pay(h), i))
    out = []
    for i, _, h in rows:
        p = pay(h)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        again = p in best and i != best[p]
        out.append((i, len(p), digest, "revisit" if again else "response", best[p] if again else None))
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROTATE", 3000)
    rows = [(i, f"http://x/{i}\r\n%", "é" * (i % 7) + "<p>" * (i % 3)) for i in range(150)]
    rows += [(200 + i, "u", "same") for i in range(80)] + [(900, None, None), (901, "", ""), (None, "n", "same"), (None, None, "alone"), (902, "u", "z" * 70_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    key = lambda t: tuple((x is None, x) for x in t)
    got = [tuple(r) for r in warc.archive_round_trip(df).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    manifest = warc.write(df)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    full = warc.read(manifest, with_payload=True).collect()
    texts = {i: (h or "").encode() for i, _, h in rows}
    urls = {i: u or "" for i, u, _ in rows}
    for r in full:
        if r.page_id is not None:
            assert r.url == urls[r.page_id] and (r.payload is None) == (r.record_type == "revisit")
            assert r.payload is None or bytes(r.payload) == texts[r.page_id]
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_package_is_a_plain_zip_of_plain_gzip_records(spark):
    df = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    path = warc.write(df).first().path.removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert b"hello" in gzip.decompress(z.read(warc.DATA)) and z.testzip() is None
    with open(path, "r+b") as f:
        at = f.read().find(b"\x1f\x8b")
        f.seek(at + 30)
        f.write(b"\x00\x01\x02")
    with pytest.raises(Exception):
        list(warc.read_package(path))
