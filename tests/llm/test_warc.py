import gzip
import hashlib
import io
import zipfile

import pytest

from lattica.llm import warc


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    members = [("a/b.bin", b"hello" * 100), ("empty", b""), ("é", b"x")]
    raw = warc.pack_zip(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    reads = []

    def read(at, n):
        reads.append(n)
        return raw[at : at + n]

    d = warc.ZipDirectory(read, len(raw))
    for name, data in members:
        at, n = d.place(name)
        assert raw[at : at + n] == data
    assert len(raw) - 22 not in reads


def test_foreign_zip_with_comment_and_compressed_member():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("stored", b"abc" * 50)
        z.writestr("packed", b"abc" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a misleading note"
    raw = b.getvalue()
    d = warc.ZipDirectory(lambda at, n: raw[at : at + n], len(raw))
    at, n = d.place("stored")
    assert raw[at : at + n] == b"abc" * 50
    with pytest.raises(ValueError):
        d.place("packed")
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: b"x" * n, 100)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 600)
    big, other = "<p>é</p>" * 200, "y" * 1000
    html = [None, "", "small", "small", big, big, big, other, "y" * 999, "y" * 999, other, "\r\n\r\n" * 300, "z" * 300_000]
    rows = [(i, f"http://x/{i}\r\n", h, "extra") for i, h in enumerate(html)]
    rows += [rows[7], rows[10]]
    rows.append((None, None, big, "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    got = list((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i is not None and best[h] > i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    key = lambda r: (r[0] if r[0] is not None else -1, r[3], r[4] or -1)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_parse():
    raw = warc.record(5, None, b"a\r\n\r\nb", None)
    assert warc.parse(gzip.decompress(gzip.compress(raw)))[1] == b"a\r\n\r\nb"
    fields, payload = warc.parse(warc.record(5, "u", b"abc", 9))
    assert payload is None and fields["WARC-Refers-To"] == "<urn:page:9>"
