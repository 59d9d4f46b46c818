import hashlib

from millrace.llm import warc

LONG, OTHER = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60, "x" * 1000
PAGES = [
    (1, "http://www.a.com/x?y#z", LONG),
    (2, "http://b.org/50%25", LONG),
    (9, "http://a.com/bad\r\nHeader: 1", LONG),
    (3, "http://c.net/", "x" * 999),
    (4, "http://c.net/", "x" * 999),
    (5, None, None),
    (6, "relative", ""),
    (7, "http://ü.de/ ü", OTHER),
    (7, "http://ü.de/ ü", OTHER),
    (None, "http://none.org/", OTHER),
]


def check(spark, rows, folder, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, folder)
    warc.build_index(spark, folder, **options)
    return warc.read(warc.lookup(spark, folder, pages)).collect()


def test_round_trip(spark, tmp_path):
    got = check(spark, PAGES, f"file:{tmp_path}/w", lines_per_block=2)
    assert len(got) == len(PAGES)
    html = {(p, (u or "").replace("\r\n", "  ")): h or "" for p, u, h in PAGES}
    for r in got:
        want = html[r.page_id, r.url or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(want.encode()), hashlib.sha1(want.encode()).hexdigest())
        if r.page_id in (1, 2):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 9, None)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("response", None, want)


def test_lookup_of_some_and_of_unknown_addresses(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/{i}", f"page {i}") for i in range(100)]
    folder = f"file:{tmp_path}/w"
    assert len(check(spark, rows, folder, lines_per_block=4)) == 100
    some = spark.createDataFrame([(5, "http://h5.org/5"), (6, "http://h5.org/5"), (8, "http://nowhere.org/")], "page_id long, url string")
    (hit,) = warc.read(warc.lookup(spark, folder, some)).collect()
    assert (hit.page_id, hit.payload) == (5, "page 5")


def test_empty_table(spark, tmp_path):
    assert check(spark, [], f"file:{tmp_path}/w") == []


def test_keys_sort_by_reversed_host():
    assert warc.key_of("http://www.A.com/X") == "com,a,www)/X"
    assert warc.sort_key("http://a.com/", 5) < warc.sort_key("http://a.com/", 10) < warc.sort_key("http://b.com/", 1)


def test_equal_keys_over_several_ranges_are_all_found(spark, tmp_path):
    rows = [(7, "http://a.org/", "same")] * 40 + [(None, None, f"p{i}") for i in range(40)] + [(i, f"http://b.org/{i}", "x") for i in range(40)]
    folder = f"file:{tmp_path}/w"
    got = check(spark, rows, folder, lines_per_block=3)
    found = spark.read.parquet(f"{folder}/blocks")
    assert found.groupBy("first").agg({"range": "max"}).count() < found.select("first", "range").distinct().count()
    assert sorted((r.page_id or -1, r.url or "", r.payload) for r in got) == sorted((p or -1, u or "", h) for p, u, h in rows)
