"""Archives: exact round trips, and every kind of damage is noticed."""

import io

import pytest

from pricemill.llm import warc

SAME = "<html>" + "same page " * 200 + "</html>"
PAGES = [
    (1, "http://a", SAME), (2, "http://b", SAME), (3, None, SAME), (4, "http://c\r\nX: y", "small"), (5, "u", "small"),
    (6, "u", None), (7, "u", ""), (8, "http://é", "é𝄞" * 900), (9, "u", "\r\n\r\n" * 400),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, archive_bytes=2000)).collect()}
    assert {(i, got[i].record_type, got[i].refers_to) for i in (1, 2, 3)} == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None)}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        assert got[page].payload_bytes == len(raw)
        if got[page].record_type == "response":
            assert bytes(got[page].payload) == raw and got[page].refers_to is None
        else:
            assert got[page].payload is None
    assert got[8].url == "http://é" and got[4].url == "http://c%0D%0AX: y" and got[3].url is None


def test_files_are_archives_as_they_lie(spark, tmp_path):
    """What stands in a file is the dictionary frame and the records, compressed once."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    made = warc.write_archives(pages, folder=str(tmp_path)).collect()
    assert sum(r.records for r in made) == len(PAGES)
    rows = [row for r in made for row in warc.read_archive(open(r.archive.removeprefix("file://"), "rb"))]
    assert sorted(r[0] for r in rows) == [p[0] for p in PAGES]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


def archive(records):
    out = io.BytesIO()
    warc.write_archive(out, records, iter([]))
    return out.getvalue()


def record(payload=b"x" * 3000, **changes):
    import hashlib

    fields = {"page_id": 1, "url": "u", "kind": "response", "refers_to": None, "digest": hashlib.sha1(payload).hexdigest(), "size": len(payload)} | changes
    return warc.encode_record(**fields, payload=payload)


@pytest.mark.parametrize(
    "data",
    [
        lambda: b"", lambda: archive([record()])[8:], lambda: archive([record()])[:-3], lambda: archive([record()]) + b"tail",
        lambda: archive([record()[:-4]]), lambda: archive([record(digest="0" * 40)]), lambda: archive([record(size=5)]),
        lambda: archive([b"HTTP/1.1 200 OK\r\n\r\n"]), lambda: archive([record().replace(b"sha1:", b"sha1:!")]),
        lambda: archive([record().replace(b"Content-Length: 3", b"Content-Length: -3")]),
        lambda: archive([record().replace(b"WARC-Date", b"WARC-Type")]), lambda: archive([record(kind="revisit", refers_to=2).replace(b"WARC-Profile", b"WARC-Other")]),
    ],
)
def test_damage_is_noticed(data):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(data())))


def test_many_records_in_small_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 8 and self.tell() > 40_000 else n)

    records = [record(bytes([65 + i % 26]) * (i * 37)) for i in range(60)]
    rows = list(warc.read_archive(Slow(archive(records))))
    assert [r[4] for r in rows] == [i * 37 for i in range(60)]


def foreign(kind, block, *fields, record_id="<http://elsewhere/1>", version="1.0"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return f"WARC/{version}\r\n".encode() + "\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"
FOREIGN = [
    foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", record_id="<urn:uuid:6b6ef1a0-0000-4000-8000-000000000001>"),
    foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
    foreign("response", b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\nbody", HTTP, "WARC-Target-URI: http://caf\xe9"),
    foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n4\r\nbody\r\n0\r\n\r\n", HTTP),
    foreign("response", b"HTTP/1.0 200\r\n\r\n", HTTP, "WARC-Concurrent-To: <a:1>", "WARC-Concurrent-To: <a:2>", "X-Folded: one", "\ttwo: three"),
    foreign("response", b"127.0.0.1", "Content-Type: text/dns", "WARC-Block-Digest: sha1:" + "4b84b15bff6ee5796152495a230e45e3d7e947d9"),
    foreign("revisit", b"", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified", "WARC-Refers-To: <http://elsewhere/0>"),
    foreign("resource", b"", version="1.1"),
]


@pytest.mark.parametrize("dictionary", [True, False])
def test_archive_of_others(spark, tmp_path, dictionary):
    import zstandard

    data = archive(FOREIGN) if dictionary else b"".join(zstandard.compress(r) for r in FOREIGN)
    (tmp_path / "a.warc.zst").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst", None)], "archive string, records long")
    rows = warc.read_archives(files).collect()
    assert [(r.record_type, r.payload and bytes(r.payload)) for r in rows] == [
        ("warcinfo", b"software: x\r\n"), ("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), ("response", b"body"),
        ("response", b"4\r\nbody\r\n0\r\n\r\n"), ("response", b""), ("response", b"127.0.0.1"), ("revisit", None), ("resource", b""),
    ]
    assert {r.page_id for r in rows} == {None} and rows[2].url == "http://café" and rows[6].refers_to_id == "<http://elsewhere/0>"


def test_null_and_repeated_ids_and_a_popular_page(spark):
    """Rows are kept one for one; rows without an id are responses, rows with the largest id too."""
    large, other = "popular " * 300, "other " * 300
    pages = [(i, "u", large) for i in range(3000)] + [(2999, "v", large), (5, "w", other), (5, "w", other), (6, None, other), (5, "x", "y")]
    pages += [(None, "u", large), (None, "u", large), (None, None, None), (None, "u", other)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)))
    rows = got.select("page_id", "url", "record_type", "refers_to", "payload_bytes").collect()
    sizes = {large: len(large), other: len(other), "y": 1, None: 0}
    largest = {large: 2999, other: 6}
    wanted = [
        (i, u, "revisit", largest[h], sizes[h]) if i is not None and i < largest.get(h, -1) else (i, u, "response", None, sizes[h])
        for i, u, h in pages
    ]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))


def test_a_revisit_of_nothing_is_noticed(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([record(), record(page_id=2, kind="revisit", refers_to=3)]))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst", 2)], "archive string, records long")
    with pytest.raises(warc.ArchiveError):
        warc.read_archives(files)
    assert warc.read_archives(files, closed=False).count() == 2
