from millrace.llm import urls
from millrace.llm.components import components
from millrace.llm.queries import URL_RULES

PAGES = [
    (1, "http://a.example.com/en/x", "block", "example.com/en/"),
    (2, "https://www.example.com/en/x", "allow", "www.example.com/en/"),
    (3, "https://w.EXAMPLE.com/fr/x?q", "allow", "com/"),
    (4, "http://s.net/es/1", "block", "net/es/"),
    (5, "http://s.net/es", "allow", None),
    (6, "http://alias.org/1", "block", None),
    (7, "https://alias.org/1#part", "block", None),
    (8, "http://both.org/1", "allow", None),
    (9, "http://far.org/3", "block", None),
    (10, "notcom/", "allow", None),
    (11, None, "allow", None),
    (12, "http://xexample.com/en/x", "allow", "com/"),
    (13, "http://com/", "allow", "com/"),
    (14, "http://com", "allow", None),
    (15, "http://alone.org/1?utm_source=feed", "allow", None),
    (1, "http://a.example.com/en/x", "block", "example.com/en/"),
]
EDGES = [
    ("http://alias.org/1", "http://s.net/es/1"),
    ("http://both.org/1", "http://s.net/fr/9"),
    ("https://www.example.com/en/x", "http://both.org/1"),
    ("http://far.org/3", "http://far.org/2"),
    ("http://far.org/2", "http://far.org/1"),
    ("http://s.net/fr/7", "http://far.org/1"),
    (None, "http://far.org/1"),
    ("relative", "http://alone.org/1"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([p[:2] for p in PAGES], "page_id long, url string")
    edges = spark.createDataFrame(EDGES, "source string, target string")
    got = [(r.page_id, r.url, r.verdict, r.rule) for r in urls.judge(pages, "url", edges, URL_RULES).collect()]
    key = lambda x: (x[0], str(x))
    assert sorted(got, key=key) == sorted(PAGES, key=key)
    assert urls.judge(pages.limit(0), "url", edges.limit(0), URL_RULES).count() == 0


def test_edges_of_pages(spark):
    rows = [
        ("http://a.org/d/p?q", '<head><LINK href="/c" rel=canonical><link rel="icon" href="/i"></head>'),
        ("http://b.org/", '<meta http-equiv="Refresh" content="0; url=//c.org/x">'),
        ("http://c.org/d/p", "<link rel='canonical' href='e'>"),
        ("http://d.org/", "canonical text <link rel=canonical>"),
        ("http://e.org/", None),
        (None, "<link rel='canonical' href='/e'>"),
    ]
    got = urls.page_edges(spark.createDataFrame(rows, "url string, html string"), "url", "html").collect()
    assert {(r.source, r.target) for r in got} == {
        ("http://a.org/d/p?q", "http://a.org/c"),
        ("http://b.org/", "http://c.org/x"),
        ("http://c.org/d/p", "http://c.org/d/e"),
    }


def test_components_of_a_chain_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500 + i, 7) for i in range(300)] + [(3, 3), (None, 4), (2, 1), (1, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 141)} | {500 + i: 7 for i in range(300)} | {7: 7, 3: 3, 1: 1, 2: 1}
    assert got == want
