import base64
import gzip
import hashlib
import random

from tallyforge.llm import warc
from tallyforge.llm.common import new_path

PAGES = "page_id long, url string, html string, payload string, n long, first string, record_type string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], PAGES)


def archived(spark, rows, **options):
    pages, path = frame(spark, rows), new_path(spark, "warc-test")
    copies = warc.catalogue(pages)
    warc.write_archives(warc.deduplicated(pages, copies, **options), path, warc.mean_record_bytes(copies))
    return path, warc.read_archives(spark, path).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n\x1f\x8b\x08 é😀\x00"
    rows = [(3, "http://a/%0A\r\nx", "same"), (1, "http://b", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (None, "n", "same"), (6, "u", tricky), (7, "u", tricky), (8, "u", "x" * 3_000_000), (9, "d", "twice"), (9, "d", "twice"), (9, "e", "twice")]
    _, got = archived(spark, rows)
    assert not [r for r in got if r.problem]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(((p, u, len((h or "").encode()), digest(h)) for p, u, h in rows), key=str)
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got if r.page_id != 9}
    assert kinds == {(1, "http://b"): ("response", None), (2, None): ("revisit", 1), (3, "http://a/%0A\r\nx"): ("revisit", 1), (None, "n"): ("revisit", 1), (4, "u"): ("response", None), (5, "u"): ("revisit", 4), (6, "u"): ("response", None), (7, "u"): ("revisit", 6), (8, "u"): ("response", None)}
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 9 and r.record_type == "revisit") == [("revisit", 9)] * 2
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payloads[6] == tricky and payloads[4] == "" and payloads[9] == "twice"


def test_least_size_and_empty(spark):
    _, got = archived(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=3)
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert archived(spark, [])[1] == []


def record(n: int, payload: bytes) -> bytes:
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    return head % (n, base64.b32encode(hashlib.sha1(payload).digest()), len(payload)) + payload + b"\r\n\r\n"


def ids(found):
    return [int(x.headers["warc-record-id"][10:-1]) for x in found if isinstance(x, warc.Record)]


def test_salvage_of_damage():
    rng = random.Random(6)
    for kind in ("plain", "member", "whole"):
        parts = [record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(400)))) for i in range(12)]
        data = b"".join(parts) if kind == "plain" else b"".join(map(gzip.compress, parts)) if kind == "member" else gzip.compress(b"".join(parts))
        assert ids(warc.salvage(data)) == list(range(12))
        assert not [x for x in warc.salvage(data) if isinstance(x, warc.Gap)]
    for _ in range(200):
        member = rng.random() < 0.5
        parts = [record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(20, 300)))) for i in range(8)]
        packed = [gzip.compress(p) for p in parts] if member else parts
        hit = rng.randrange(8)
        broken = bytearray(packed[hit])
        how = rng.randrange(3)
        if how == 0:
            del broken[len(broken) // 2 :]
        elif how == 1:
            broken[len(broken) // 2 if member else len(broken) - 8] ^= 0x55
        else:
            broken = bytearray(b"noise WARC/1.1\r\n") + broken[20:]
        data = b"".join([*packed[:hit], bytes(broken), *packed[hit + 1 :]])
        found = list(warc.salvage(data))
        assert set(range(8)) - {hit} <= set(ids(found))
        spans = sorted((x.start, x.end) if x.member is None else (x.member, x.member) for x in found)
        assert any(isinstance(x, warc.Gap) for x in found) or hit in ids(found)
        if not member:
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_junk():
    assert [type(x) for x in warc.salvage(b"")] == []
    assert [(x.start, x.end) for x in warc.salvage(b"\x1f\x8b\x08" * 50)] == [(0, 150)]
    assert ids(warc.salvage(b"junk" + record(1, b"") + b"WARC/1.1\r\nContent-Length: 99999999999999\r\n\r\n" + record(2, b"x"))) == [1, 2]


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"HTTP/1.1 200 OK\r\n\r\nhi") + b"garbage" + record(2, b"HTTP/1.1 200 OK\r\n\r\nho"))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.page_id, r.payload) for r in got if r.problem is None) == [(1, "hi"), (2, "ho")]
    [gap] = [r for r in got if r.problem]
    assert gap.end - gap.start == len(b"garbage")


URLS = ["http://a/", "http://x/spec/WARC/1.1", "http://y/WARC/1.0", "http://z/\r\nWARC/1.1\r\nWARC-Type: response", "WARC/1.1", "http://b/"]


def test_urls_like_version_lines(spark):
    _, got = archived(spark, [(i, u, f"page {i}") for i, u in enumerate(URLS)])
    assert sorted((r.page_id, r.url, r.record_type, r.payload, r.problem) for r in got) == [(i, u, "response", f"page {i}", None) for i, u in enumerate(URLS)]


def test_query_counts_records(spark, tmp_path):
    import pytest

    frame(spark, [(i, u, "same") for i, u in enumerate(URLS)]).write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc.op9_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [(0, "response", None), *((i, "revisit", 0) for i in range(1, 6))]
    records = spark.createDataFrame([("p", None, None)], "path string, problem string, page_id long")
    with pytest.raises(RuntimeError):
        warc.check_complete(records, spark.createDataFrame([(2,)], "n long"))


def test_foreign_records(spark, tmp_path):
    """Repeated and folded fields, records of other types, no block digest."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 21\r\n\r\nsoftware: x\r\n\r\nrest!!\r\n\r\n"
    many = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Concurrent-To: <urn:a>\r\nWARC-Target-URI: http://x/WARC/1.1\r\nWARC-Concurrent-To: <urn:b>\r\nWARC-Record-ID: <urn:uuid:2>\r\nX-Note: one\r\n  two\r\n\tthree\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n"
    found = list(warc.salvage(info + many + record(3, b"x")))
    assert [type(x) for x in found] == [warc.Record] * 3
    assert found[1].headers["x-note"] == "one two three" and found[1].headers["warc-concurrent-to"] == "<urn:a>"
    (tmp_path / "a.warc").write_bytes(info + many + record(3, b"HTTP/1.1 200 OK\r\n\r\nhi"))
    got = {r.record_type: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert (got["warcinfo"].payload_bytes, got["warcinfo"].page_id, got["warcinfo"].payload_digest) == (21, None, digest("software: x\r\n\r\nrest!!"))
    assert (got["request"].url, got["request"].payload_bytes) == ("http://x/WARC/1.1", 0) and got["response"].payload == "hi"


def test_lost_ends():
    """Two records with the end of one lost are not one; damage hides no later record, and no record is made of a damaged one's tail or payload."""
    one, two = record(1, b"first block" * 20), record(2, b"second")
    for cut in range(len(one)):
        found = list(warc.salvage(one[:cut] + two + record(3, b"third")))
        assert ids(found) == [2, 3], cut
    inner = record(9, b"an example in a page")
    broken = bytearray(record(1, b"about WARC: " + inner + b" and more"))
    broken[-12] ^= 1
    found = list(warc.salvage(bytes(broken) + two))
    assert ids(found) == [2] and [(x.start, x.end, x.problem) for x in found if isinstance(x, warc.Gap)] == [(0, len(broken), "block digest")]
    tail = record(1, b"x").replace(b"WARC-Date", b"WARC-Target-URI: http://x/WARC/1.1\r\nWARC-Date")
    assert ids(warc.salvage(tail)) == [1]
    assert ids(warc.salvage(b"?" + tail[1:] + two)) == [2]


def test_archives_by_size(spark, monkeypatch):
    """Files stay within bounds however unequal the records are."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(2)
    rows = [(i, "u", f"{i} " + "x" * (rng.choice([10, 10, 10, 10, 10, 6000, 9000, 50_000]))) for i in range(300)]
    path, got = archived(spark, rows)
    assert sorted((r.page_id, r.payload) for r in got) == [(i, h) for i, _, h in rows] and not [r for r in got if r.problem]
    sizes = {}
    for r in got:
        sizes.setdefault(r.path, []).append(r.end - r.start)
    assert all(sum(x) <= 20_000 * 8 or len(x) == 1 for x in sizes.values())
    assert all(sum(x) <= 20_000 or len(x) == 1 for p, x in sizes.items() if "/large/" in p)
