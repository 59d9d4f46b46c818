from millrace.operators import pages


def test_pages_of_many_unclosed_tags_do_not_stop_the_job(spark):
    html = "".join(f"<p>{i}" for i in range(1500)) + "<b class='x'>a&amp;<br>c</b>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    row = pages.extract_fields(df, "id", "html", {"p": "p", "b": "b.x::html", "whole": "p::html"}).first()
    assert (len(row.p), row.p[-1], row.b) == (1500, "1499a&c", ['<b class="x">a&amp;<br>c</b>'])
    assert row.whole[-1] == '<p>1499<b class="x">a&amp;<br>c</b></p>'


def test_the_digits_of_an_amount_are_no_year(spark):
    head = '<meta property="og:description" content="%s">'
    rows = [(1, "from $ 1900,50 in 2000"), (2, "2004, $2010"), (3, "$ 1999"), (4, "1987 or 1990"), (5, "none")]
    df = spark.createDataFrame([(k, head % text) for k, text in rows], "id long, html string")
    got = {r.id: (r.price, r.year) for r in pages.page_meta(df, "id", "html", {}).collect()}
    assert got == {1: ("1900,50 USD", 2000), 2: ("2010 USD", 2004), 3: ("1999 USD", None), 4: (None, 1987), 5: (None, None)}
