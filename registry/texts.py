"""Text, vector and page queries."""

from pyspark.sql import functions as F

from millrace.operators import nearest, pages, text, textindex
from registry import query, rounded, scratch, table

CHARS = text.EMBED_CHARACTERS
SHARES = ", ".join(
    "(LENGTH(t) - LENGTH(REPLACE(t, '{}', '')))::DOUBLE / GREATEST(LENGTH(t), 1)".format(c) for c in CHARS
)
TOKENS = r"REGEXP_EXTRACT_ALL(LOWER(text), '[\p{L}\p{N}]+')"


@query(
    "embed_chars",
    f"""
    WITH l AS (SELECT doc_id, LOWER(text) AS t FROM documents), v AS (SELECT doc_id, [{SHARES}] AS v FROM l),
         u AS (SELECT doc_id, UNNEST(v) AS x, UNNEST(RANGE(0, {len(CHARS)})) AS pos, SQRT(LIST_SUM(LIST_TRANSFORM(v, lambda x: x * x))) AS n FROM v)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, ROUND(x / n, 6) AS value FROM u WHERE x > 0
    """,
)
def _(spark, sf):
    embedded = text.embed_chars(table(spark, sf, "documents"), "text")
    return rounded(embedded.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value > 0"), 6)


@query(
    "tokenize",
    f"SELECT doc_id, LEN({TOKENS}) AS tokens, LEN(LIST_DISTINCT({TOKENS})) AS distinct_tokens FROM documents",
)
def _(spark, sf):
    done = text.tokenize(table(spark, sf, "documents"), "text")
    return done.select(
        "doc_id",
        F.size("tokens").cast("long").alias("tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("distinct_tokens"),
    )


TFIDF_SQL = f"""
    t AS (SELECT doc_id, UNNEST({TOKENS}) AS term FROM documents),
    c AS (SELECT doc_id, term, COUNT(*) AS n, MAX(COUNT(*)) OVER (PARTITION BY doc_id) AS most FROM t GROUP BY 1, 2),
    f AS (SELECT term, COUNT(*) AS df FROM c GROUP BY 1 ORDER BY df DESC, term LIMIT 128),
    v AS (SELECT term, CAST(ROW_NUMBER() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS idx, LN(((SELECT COUNT(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM f),
    w AS (SELECT doc_id, idx, n / most * idf AS w, SQRT(SUM(POW(n / most * idf, 2)) OVER (PARTITION BY doc_id)) AS l FROM c JOIN v USING (term))"""


@query("embed_tfidf", f"WITH {TFIDF_SQL} SELECT doc_id, idx, ROUND(w / l, 6) AS weight FROM w")
def _(spark, sf):
    rows, _ = text.embed_tfidf(table(spark, sf, "documents"), "doc_id", "text")
    return rounded(rows.where("idx IS NOT NULL"), 6)


QUESTION = "the thing and other things of that"


SEARCH_SQL = f"""WITH t AS (SELECT doc_id, UNNEST({TOKENS}) AS term FROM documents),
      c AS (SELECT doc_id, term, COUNT(*) AS n, MAX(COUNT(*)) OVER (PARTITION BY doc_id) AS most FROM t GROUP BY 1, 2),
      v AS (SELECT term, LN(((SELECT COUNT(*) FROM documents) + 1) / (COUNT(*) + 1)) + 1 AS idf FROM c GROUP BY term),
      w AS (SELECT doc_id, term, n / most * idf AS w, SQRT(SUM(POW(n / most * idf, 2)) OVER (PARTITION BY doc_id)) AS l FROM c JOIN v USING (term)),
      q AS (SELECT UNNEST(REGEXP_EXTRACT_ALL('{QUESTION}', '[a-z]+')) AS term), qc AS (SELECT term, COUNT(*) AS n, MAX(COUNT(*)) OVER () AS most FROM q GROUP BY 1),
      qw AS (SELECT term, n / most * idf AS w, SQRT(SUM(POW(n / most * idf, 2)) OVER ()) AS l FROM qc JOIN v USING (term))
    SELECT doc_id, ROUND(SUM(w.w / w.l * qw.w / qw.l), 6) AS score FROM w JOIN qw USING (term)
    GROUP BY 1 HAVING ROUND(SUM(w.w / w.l * qw.w / qw.l), 6) > 0 ORDER BY score DESC, doc_id LIMIT 10"""


@query("semantic_search", SEARCH_SQL)
def _(spark, sf):
    return text.semantic_search(table(spark, sf, "documents"), "doc_id", "text", QUESTION, 10)


@query("text_index", SEARCH_SQL)
def _(spark, sf):
    """An index of two loads, of which the second replaces some texts of the first."""
    docs, folder = table(spark, sf, "documents"), scratch(spark)
    textindex.add(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 1, "old words").otherwise(F.col("text"))), "doc_id", "text", folder)
    textindex.add(docs.where("doc_id % 3 < 2"), "doc_id", "text", folder)
    return textindex.Index(spark, folder).search(QUESTION, 10).withColumnRenamed("key", "doc_id")


COSINE = "LIST_SUM(LIST_TRANSFORM(LIST_ZIP({a}, {b}), lambda p: p[1]::DOUBLE * p[2]))"


@query(
    "vector_cosine",
    f"""WITH c AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS a, f.embedding::DOUBLE[] AS b FROM embeddings e JOIN embeddings f ON f.vec_id = 0)
    SELECT vec_id, ROUND({COSINE.format(a="a", b="b")} / SQRT({COSINE.format(a="a", b="a")}) / SQRT({COSINE.format(a="b", b="b")}), 6) AS cosine,
           ROUND(SQRT(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean FROM c""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").scalar()
    a, b = F.col("embedding"), F.col("first")
    both = vectors.withColumn("first", first)
    return rounded(both.select("vec_id", text.cosine(a, b).alias("cosine"), text.euclidean(a, b).alias("euclidean")), 6)


TOP_SQL = f"""
    WITH n AS (SELECT vec_id, LIST_TRANSFORM(embedding::DOUBLE[], lambda x: x / SQRT({COSINE.format(a="embedding::DOUBLE[]", b="embedding::DOUBLE[]")})) AS u, label FROM embeddings),
         s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {COSINE.format(a="q.u", b="c.u")} AS score FROM n q, n c),
         r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(score, 12) DESC, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, id, ROUND(score, 6) AS score, rank FROM r WHERE rank <= 5
    """


@query("top_k_similar", TOP_SQL)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = text.top_k_similar(vectors, vectors, 5, "vec_id", "embedding", "vec_id", "embedding")
    return rounded(found, 6)


@query("top_k_pruned", TOP_SQL)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = nearest.top_k_pruned(vectors, vectors, 5, "vec_id", "embedding", "vec_id", "embedding")
    return rounded(found.drop("parts_searched", "parts"), 6)


@query(
    "upsert_items",
    """SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0""",
)
def _(spark, sf):
    base = table(spark, sf, "embeddings").select("vec_id", "label")
    changed = base.where("vec_id % 5 = 0")
    new = changed.select("vec_id", (F.col("label") + 50).alias("label"), F.lit(1).alias("at")).unionByName(
        changed.select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("at"))
    )
    return text.upsert_items(base, new, "vec_id", "at")


@query("delete_items", "SELECT vec_id, label FROM embeddings WHERE label <> 3")
def _(spark, sf):
    base = table(spark, sf, "embeddings").select("vec_id", "label")
    return text.delete_items(base, base.where("label = 3"), "vec_id")


@query(
    "top_variance_dims",
    """
    WITH p AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS x, UNNEST(RANGE(1, LEN(embedding) + 1)) AS pos FROM embeddings),
         v AS (SELECT pos, ROW_NUMBER() OVER (ORDER BY VAR_POP(x) DESC, pos) AS rk FROM p GROUP BY pos)
    SELECT vec_id, ROUND(MAX(x) FILTER (rk = 1), 6) AS d1, ROUND(MAX(x) FILTER (rk = 2), 6) AS d2 FROM p JOIN v USING (pos) GROUP BY 1
    """,
)
def _(spark, sf):
    cut = text.top_variance_dims(table(spark, sf, "embeddings"), "vec_id", "embedding", 2)
    return rounded(cut.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("d1"), F.get("embedding", F.lit(1)).cast("double").alias("d2")), 6)


LEXICON_SQL = f"""
    t AS (SELECT doc_id, UNNEST({TOKENS}) AS term FROM documents),
    x AS (SELECT term, (LENGTH(term) % 5 - 2)::DOUBLE AS valence FROM t GROUP BY 1),
    s AS (SELECT doc_id, COALESCE(SUM(valence), 0) AS s FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN x USING (term) GROUP BY 1),
    c AS (SELECT doc_id, s / SQRT(s * s + 15) AS c FROM s)"""
LABEL_SQL = "CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END"


def lexicon(spark, sf):
    """Every word of the documents with a valence from its length."""
    words = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return words.withColumn("valence", (F.length("term") % 5 - 2).cast("double"))


@query(
    "sentiment",
    f"WITH {LEXICON_SQL} SELECT doc_id, ROUND(c, 6) AS compound, {LABEL_SQL} AS label, SUBSTR(text, 1, 50) AS snippet FROM c JOIN documents USING (doc_id)",
)
def _(spark, sf):
    return rounded(text.sentiment(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark, sf)), 6)


@query(
    "sentiment_breakdown",
    f"""WITH {LEXICON_SQL}, l AS (SELECT c, {LABEL_SQL} AS label FROM c)
    SELECT COUNT(*) AS total, COUNT(*) FILTER (label = 'positive') AS positive, COUNT(*) FILTER (label = 'negative') AS negative,
           COUNT(*) FILTER (label = 'neutral') AS neutral, ROUND(AVG(c), 6) AS mean_compound FROM l""",
)
def _(spark, sf):
    scored = text.sentiment(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark, sf))
    return rounded(text.sentiment_breakdown(scored), 6)


@query("keyword_search", "SELECT p_partkey, p_name, p_type FROM part WHERE LOWER(p_name) LIKE '%ring%' OR LOWER(p_type) LIKE '%ring%'")
def _(spark, sf):
    return text.keyword_search(table(spark, sf, "part"), ["p_name", "p_type"], "RING").select("p_partkey", "p_name", "p_type")


# --- pages --------------------------------------------------------------------------------------

CODE = r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE({h}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g')"
DRESSED = """concat(replace(html, '</body>', concat('<img alt="x" src="/img/', page_id, '.png"><img src=''//cdn.example/a&amp;b''>',
    '<video controls><source src="/v/', page_id, '.mp4"></video><audio><source src=/a.mp3></audio></body>')))"""


def dressed(spark, sf):
    """Pages with an image, a video and a sound added to their body."""
    return table(spark, sf, "pages").withColumn("html", F.expr(DRESSED))


def _attr_sql(tag, attr):
    return (
        "LIST_TRANSFORM(REGEXP_EXTRACT_ALL({h}, '(?is)<" + tag + r"\b[^>]*?\s" + attr + r"\s*=\s*(\"[^\"]*\"|''[^'']*''|[^\s>]+)', 1), "
        "lambda u: REPLACE(REGEXP_REPLACE(u, '^[\"'']|[\"'']$', '', 'g'), '&amp;', '&'))"
    ).replace('\\"', '"')


def _links_sql(tag, attr, source):
    urls = _attr_sql(tag, attr).format(h="h")
    return f"""WITH s AS (SELECT page_id, {CODE.format(h=source)} AS h FROM pages), u AS (SELECT page_id, {urls} AS urls FROM s)
    SELECT page_id, CAST(UNNEST(RANGE(0, LEN(urls))) AS INTEGER) AS pos, UNNEST(urls) AS url FROM u"""


@query("page_links", _links_sql("a", "href", "html"))
def _(spark, sf):
    return pages.page_links(table(spark, sf, "pages"), "page_id", "html")


@query("page_images", _links_sql("img", "src", DRESSED))
def _(spark, sf):
    return pages.page_images(dressed(spark, sf), "page_id", "html")


@query(
    "page_media",
    f"""WITH s AS (SELECT page_id, {CODE.format(h=DRESSED)} AS h FROM pages),
      b AS (SELECT page_id, REGEXP_EXTRACT_ALL(h, '(?is)<(?:video|audio)\\b[^>]*>.*?</(?:video|audio)\\s*>') AS bs FROM s),
      u AS (SELECT page_id, FLATTEN(LIST_TRANSFORM(bs, lambda b: {_attr_sql("source", "src").format(h="b")})) AS urls FROM b)
    SELECT page_id, CAST(UNNEST(RANGE(0, LEN(urls))) AS INTEGER) AS pos, UNNEST(urls) AS url FROM u""",
)
def _(spark, sf):
    return pages.page_media(dressed(spark, sf), "page_id", "html")


PLAIN = r"TRIM(REGEXP_REPLACE(REGEXP_REPLACE({h}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "page_summary",
    rf"""
    SELECT page_id, TRIM(REGEXP_EXTRACT(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
           ARRAY_TO_STRING(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: TRIM(h)), '|') AS headings,
           LEN(REGEXP_EXTRACT_ALL(html, '(?i)<table')) AS tables, LEN(REGEXP_EXTRACT_ALL(html, '(?i)<img')) AS images,
           LEN(REGEXP_EXTRACT_ALL(html, '(?i)<a ')) AS links, {PLAIN.format(h="html")} AS text
    FROM pages
    """,
)
def _(spark, sf):
    done = pages.page_summary(table(spark, sf, "pages"), "page_id", "html")
    counts = {c: F.col(c).cast("long") for c in ("tables", "images", "links")}
    return done.withColumns({"headings": F.array_join("headings", "|"), **counts})


@query(
    "page_text",
    rf"""
    WITH s AS (SELECT page_id, REGEXP_REPLACE(REGEXP_REPLACE(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS h FROM pages),
         b AS (SELECT page_id, CASE WHEN REGEXP_MATCHES(h, '(?is)<body[^>]*>(.*?)</body>') THEN REGEXP_EXTRACT(h, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE h END AS h FROM s)
    SELECT page_id, {PLAIN.format(h="h")} AS text FROM b
    """,
)
def _(spark, sf):
    return pages.page_text(table(spark, sf, "pages"), "page_id", "html")


@query("extract_fields")
def _(spark, sf):
    rules = {"title": "title::text", "links": "nav a::attr(href)", "items": {"root": "li", "fields": {"name": "a::text", "url": "a::attr(href)"}}}
    found = pages.extract_fields(table(spark, sf, "pages"), "page_id", "html", rules)
    return found.select(
        "page_id",
        F.get("title", F.lit(0)).alias("title"),
        F.array_join("links", " ").alias("links"),
        F.array_join(F.transform("items", lambda m: m["name"]), " ").alias("names"),
    )


@query(
    "text_stats",
    r"""SELECT doc_id, CAST(LEN(STRING_SPLIT(text, CHR(10))) AS INTEGER) AS line_count, CAST(LENGTH(text) AS INTEGER) AS char_count,
        CAST(LEN(REGEXP_EXTRACT_ALL(text, '\S+')) AS INTEGER) AS word_count,
        CAST(LEN(STRING_SPLIT(STRING_SPLIT(text, CHR(10))[1], ',')) AS INTEGER) AS csv_columns FROM documents""",
)
def _(spark, sf):
    return pages.text_stats(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "dedup_by_content",
    """SELECT SHA256(text) AS hash, MIN(doc_id) AS first_key, COUNT(*) AS copies, CAST(MAX(STRLEN(text)) AS INTEGER) AS bytes FROM documents GROUP BY 1""",
)
def _(spark, sf):
    return pages.dedup_by_content(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "content_totals",
    """WITH h AS (SELECT source, SHA256(text) AS h, COUNT(*) AS n, MAX(STRLEN(text)) AS b FROM documents GROUP BY 1, 2)
       SELECT source, CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS unique_contents, CAST(SUM(b) AS BIGINT) AS unique_bytes FROM h GROUP BY 1""",
)
def _(spark, sf):
    return pages.content_totals(table(spark, sf, "documents"), "source", "text")


@query("gc", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return pages.gc(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query(
    "spec_endpoints",
    """
    SELECT r_regionkey, r_name AS title, '2.' || r_regionkey AS version, 'https://' || LOWER(r_name) || '.example/v1' AS base_url, 'Bearer' AS auth_type,
           '/' || n_name AS path, m.method, CASE m.method WHEN 'GET' THEN 'read ' || n_name ELSE '' END AS summary, m.method = 'POST' AS auth_required
    FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('GET'), ('POST')) m(method)
    """,
)
def _(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    call = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("read "), "n_name").alias("summary")).alias("get"),
            F.struct(F.array(F.struct(F.array(F.lit("x")).alias("token"))).alias("security")).alias("post"),
            F.lit("shared").alias("parameters"),
        )
    )
    pieces = nations.groupBy("r_regionkey", "r_name").agg(
        F.array_join(F.collect_list(F.concat(F.lit('"/'), "n_name", F.lit('": '), call)), ", ").alias("paths")
    )
    spec = F.concat(
        F.lit('{"openapi": "3.0.0", "info": {"title": "'), "r_name", F.lit('", "version": "2.'), "r_regionkey",
        F.lit('"}, "servers": [{"url": "https://'), F.lower("r_name"), F.lit('.example/v1"}], "components": {"securitySchemes": '),
        F.lit('{"token": {"type": "http", "scheme": "bearer"}}}, "paths": {'), "paths", F.lit("}}"),
    )
    return pages.spec_endpoints(pieces.withColumn("spec", spec), "r_regionkey", "spec")


META = """concat('<head><meta property="og:title" content=" ', page_id, ' "><meta content="from $ ', page_id, ',50 in ', 1990 + page_id % 30,
    '" property=''og:description''><meta property="og:image" content="//a/', page_id, '"></head><img src="//a/', page_id, '"><img src="/b">', html)"""


@query(
    "page_meta",
    f"""
    SELECT page_id, CAST(page_id AS VARCHAR) AS title, CAST(page_id AS VARCHAR) || ',50 USD' AS price, CAST(1990 + page_id % 30 AS INTEGER) AS year,
           'https://a/' || page_id || ' /b' AS images FROM pages
    """,
)
def _(spark, sf):
    marked = table(spark, sf, "pages").withColumn("html", F.expr(META))
    done = pages.page_meta(marked, "page_id", "html", {"title": "og:title"})
    return done.withColumn("images", F.array_join("images", " "))
