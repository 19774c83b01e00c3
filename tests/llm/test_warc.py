import hashlib

import pytest

from tintwerk.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to int"


def test_round_trip_and_revisits(spark):
    long, other = "ä" * 60, "b" * 100
    rows = [(5, "u5", long), (2, "u\r\n2", long), (9, None, long), (1, "u1", "kurz"), (3, "u3", "kurz"), (4, "u4", None), (6, "u6", ""), (7, "u7", other), (8, "u8", "c" * 99), (10, "u10", "c" * 99), (11, "x", "y" * 3_000_000)]
    got = {r.page_id: r for r in warc.archive_report(spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 2, 9: 2}


def test_repeated_and_null_rows(spark):
    x = "x" * 200
    rows = [(2, "u", x), (2, "u", x), (3, "u", x), (None, "u", x), (None, "u", "z" * 200), (None, "v", "z" * 200)]
    got = warc.archive_report(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(2, "response", None), (2, "response", None), (3, "revisit", 2), (None, "revisit", 2), (None, "response", None), (None, "response", None)], key=str)
    assert all(r.payload_bytes == 200 for r in got)
    assert warc.archive_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "<p>é</p>")], "page_id long, url string, html string"))
    row = warc.read_archives(manifest, with_payload=True).first()
    assert bytes(row.payload) == "<p>é</p>".encode() and row.url == "u"


def test_reader_finds_damage():
    record = warc.record_bytes("response", 1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    good = warc.member(record) * 2
    blocks = lambda data, n=7: (data[i : i + n] for i in range(0, len(data), n))
    assert [p for _, p, _ in warc.records(blocks(good))] == [b"abc", b"abc"]
    assert list(warc.records(iter([]))) == []
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(good[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(warc.member(record.replace(b"abc", b"abd")))))
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(warc.member(record[:-6]))))
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(b"no archive at all")))
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(warc.member(record + b"more"))))
    with pytest.raises(warc.WarcError):
        list(warc.records(blocks(warc.member(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"))))


def test_reader_takes_no_more_than_it_needs(monkeypatch):
    """A member that inflates to far more than its record says is refused before it is inflated whole."""
    monkeypatch.setattr(warc, "BLOCK", 1000)
    bomb = warc.member(warc.record_bytes("response", 1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None) + b"0" * 50_000_000)
    stream = warc._Members(iter([bomb]))
    assert stream.begin()
    with pytest.raises(warc.WarcError):
        warc.framed(stream)
    assert len(stream.held) < 10_000
    with pytest.raises(warc.WarcError):
        list(warc.records(iter([warc.member(b"WARC/1.1\r\n" + b"x" * 3_000_000)])))


def test_many_blocks_and_revisits():
    page = b"z" * 5000
    digest = hashlib.sha256(page).hexdigest()
    raw = b"".join(warc.member(warc.record_bytes(kind, i, "u", page, digest, None if kind == "response" else 0)) for i, kind in enumerate(["response", "revisit", "revisit"]))
    for n in (1, 13, 4096, len(raw)):
        got = list(warc.records(raw[i : i + n] for i in range(0, len(raw), n)))
        assert [(len(p), size) for _, p, size in got] == [(5000, 5000), (0, 5000), (0, 5000)]


def test_long_payload(spark):
    html = "<p>" + "lang und länger " * 1_500_000
    got = warc.archive_report(spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in got} == {(1, len(html.encode()), "response"), (2, len(html.encode()), "revisit")}
