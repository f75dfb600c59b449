import hashlib

from cellweave.llm import warc
from cellweave.llm._shared import work_dir

LONG = "<p>é</p>" * 300
PAGES = [(1, "http://a/", LONG), (2, "http://b/", LONG), (2, "http://b/", LONG), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "short"), (6, "u", "short"), (None, "n", LONG), (7, "z", "\r\n\r\nWARC/1.1\r\n" * 100)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, digest string")
    index = warc.write_archives(pages, work_dir(spark, "test"), frame_bytes=500)
    got = warc.read_archives(index, with_payload=True).collect()
    expected = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = max((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(data) >= 1000 else None
        kind, refers = ("response", None) if first is None or first == page_id else ("revisit", first)
        expected.append((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, refers, data if kind == "response" else None))
    told = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(repr, told)) == sorted(map(repr, expected))
    wanted = index.where("page_id in (5, 7)").select("record_id")
    assert sorted(bytes(r.payload) for r in warc.look_up(index, wanted).collect()) == [b"\r\n\r\nWARC/1.1\r\n" * 100, b"short"]


def test_identifiers_are_unique_and_shuffled_digests_agree(spark, monkeypatch):
    rows = [*PAGES, PAGES[0], (None, "n", LONG), (8, "v", None), (8, "v", ""), (9, "big", "xy" * 400_000)]
    pages = spark.createDataFrame([(*p, "x", "y", 1) for p in rows], "page_id bigint, url string, html string, digest string, record_id string, bytes int").repartition(3)
    told = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        index = warc.write_archives(pages, work_dir(spark, "test"), frame_bytes=500)
        assert index.select("record_id").distinct().count() == len(rows)
        assert warc.look_up(index, index.select("record_id")).count() == len(rows)
        told.append(sorted(map(repr, warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    assert told[0] == told[1] and len(told[0]) == len(rows)


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
