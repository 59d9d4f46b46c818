"""The operators as queries over the test tables, with an oracle where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import shared_folder
from millrace.llm import codes, collocations, forest, mixing, neardup, packing, pieces, rules, secrets, sharding, suffixes, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_nbest_pieces(spark, sf):
    """The four best segmentations of every document, and a checksum of what the best one decodes to."""
    return pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SHARDS = 40


@query
def op2_hash_tree(spark, sf):
    """Documents on shards 0 to 39 under law ``key``; the grown tree has one shard more."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = sharding.shard(narrow, ["doc_id"], sharding.layout(SHARDS), sharding.layout(SHARDS + 1))
    return sharding.number(placed)


@query
def op3_prefix_forest(spark, sf):
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf, "embeddings")
    return forest.search(vectors, vectors.where("vec_id % 100 = 0"))


URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def _host(url: str) -> str:
    return f"COALESCE(TRANSLATE(REGEXP_EXTRACT({_rest(url)}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(url: str) -> str:
    return f"COALESCE(REGEXP_EXTRACT({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _rest(url: str) -> str:
    return f"CASE WHEN INSTR({url}, '://') > 0 THEN SUBSTR({url}, INSTR({url}, '://') + 3) END"


_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ENDS_WITH(host, '.{r.host}')) AND STARTS_WITH(path, '{r.path}') THEN '{r.verdict} {r.name}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name))
)
ORACLES["op4_redirect_equivalence"] = rf"""
WITH RECURSIVE
t AS (SELECT url, UNNEST(REGEXP_EXTRACT_ALL(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
l AS (SELECT url, CASE WHEN REGEXP_MATCHES(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN REGEXP_EXTRACT(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
                       WHEN REGEXP_MATCHES(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
                       THEN REGEXP_EXTRACT(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?\s*([^"''\s>]+)', 1) END AS link FROM t),
s AS (SELECT url, link, SPLIT_PART(url, '://', 1) AS scheme, {_host("url")} AS host, REGEXP_EXTRACT({_path("url")}, '^.*/') AS folder FROM l WHERE link <> ''),
e AS (SELECT url AS a, CASE WHEN REGEXP_MATCHES(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN STARTS_WITH(link, '//') THEN scheme || ':' || link
                            WHEN STARTS_WITH(link, '/') THEN scheme || '://' || host || link
                            ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS b FROM s),
every AS (SELECT url AS u FROM pages UNION SELECT a FROM e UNION SELECT b FROM e),
n AS (SELECT u, {_host("u")} AS host, {_path("u")} AS path, REGEXP_REPLACE({_rest("u")}, '(?s)#.*$', '') AS rest FROM every WHERE u IS NOT NULL),
q AS (SELECT *, CASE {_FITS} END AS rule,
        ARRAY_TO_STRING(LIST_FILTER(STRING_SPLIT(CASE WHEN INSTR(rest, '?') > 0 THEN SUBSTR(rest, INSTR(rest, '?') + 1) END, '&'),
                                    lambda x: x <> '' AND NOT REGEXP_MATCHES(x, '^(?i:utm_[a-z]+|gclid|fbclid)=')), '&') AS kept FROM n),
k AS (SELECT u, host, path, rule, REGEXP_REPLACE(host, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END
                                  || CASE WHEN COALESCE(kept, '') <> '' THEN '?' || kept ELSE '' END AS key FROM q WHERE rest IS NOT NULL),
both_ways AS (SELECT x.key AS a, y.key AS b FROM e JOIN k x ON x.u = e.a JOIN k y ON y.u = e.b UNION SELECT y.key, x.key FROM e JOIN k x ON x.u = e.a JOIN k y ON y.u = e.b),
reach AS (SELECT DISTINCT key AS a, key AS b FROM k UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
said AS (SELECT a, BOOL_OR(rule LIKE 'block %') AS blocks, BOOL_OR(rule LIKE 'allow %') AS allows FROM reach JOIN k ON k.key = reach.b GROUP BY a)
SELECT page_id, COALESCE(k.host, '') AS host, COALESCE(k.path, '') AS path, SPLIT_PART(k.rule, ' ', 2) AS rule,
       COALESCE(SPLIT_PART(k.rule, ' ', 1), CASE WHEN blocks AND NOT COALESCE(allows, FALSE) THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN k ON k.u = pages.url LEFT JOIN said ON said.a = k.key
"""


@query
def op4_redirect_equivalence(spark, sf):
    """Every page's address, judged by the rules and by what its canonical links and refresh tags connect it to."""
    pages = table(spark, sf, "pages")
    judged = urls.judge(pages.select("page_id", "url"), "url", urls.page_edges(pages, "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op5_best_fit(spark, sf):
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
ORACLES["op7_threshold_table"] = rf"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, LIST_FILTER(STRING_SPLIT_REGEX(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        LIST_FILTER(STRING_SPLIT(t, CHR(10)), lambda x: REGEXP_MATCHES(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, UNNEST(RANGE(1, LEN(w) - 3)) AS i,
        UNNEST(LIST_TRANSFORM(RANGE(1, LEN(w) - 3), lambda i: ARRAY_TO_STRING(w[i:i + 4], ' '))) AS g FROM w WHERE LEN(w) >= 5),
c AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, i, LEAD(i) OVER (PARTITION BY r ORDER BY i) AS following FROM c WHERE n > 1),
k AS (SELECT r, SUM(LEAST(5, COALESCE(following - i, 5))) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT doc_id, LEN(w) AS n_words, LENGTH(REGEXP_REPLACE(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        LENGTH(REGEXP_REPLACE(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, LEN(l) - LEN(LIST_DISTINCT(l)) AS n_dup_lines,
        COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words, LEN(l) AS n_lines,
        LENGTH(REGEXP_REPLACE(t, '[^!]', '', 'g')) AS n_shouts, LENGTH(REGEXP_REPLACE(t, '[^A-Z]', '', 'g')) AS n_capitals,
        LEN(LIST_FILTER(w, lambda x: LOWER(x) IN ({_STOPS}))) AS n_stop_words
      FROM w LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars / n_words < 1.5 OR word_chars / n_words > 20 OR n_symbols / n_words > 0.2 OR n_shouts / n_words > 0.3
            OR n_capitals / word_chars > 0.6 OR (n_words >= 120 AND n_stop_words / n_words < 0.01) OR n_dup_lines / n_lines > 0.5) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""


@query
def op7_threshold_table(spark, sf):
    """The metrics of every document, the base rules and the verdict of the whole table of thresholds."""
    judged = rules.judge(table(spark, sf, "documents").select("doc_id", "text"), "text")
    q = F.col("quality")
    base = F.array(*[F.lit(r.name) for r in rules.BASE])
    return judged.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.arrays_overlap(q["failed"], base).alias("base_failed"),
        q["kept"].alias("kept"),
    )


ORACLES["op9_capture_index"] = """
WITH p AS (SELECT page_id, OCTET_LENGTH(ENCODE(COALESCE(html, ''))) AS payload_bytes, SHA1(COALESCE(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
FROM h
"""


@query
def op9_capture_index(spark, sf):
    """Write every page into archives, index them, look every page up and read its record's byte range back."""
    pages, folder = table(spark, sf, "pages"), f"{shared_folder(spark)}/warc-{uuid4().hex}"
    warc.write(pages, folder)
    warc.build_index(spark, folder)
    found = warc.read(warc.lookup(spark, folder, pages), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_markov(spark, sf):
    """Secrets of every document: the fixed patterns, and what Markov models trained on the corpus add."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, "text")
    return found.select("doc_id", *[F.col("secrets")[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


@query
def op8_lsh_forest(spark, sf):
    """Groups of documents that 3-word shingle sets of a similarity of 0.85 or more connect."""
    return neardup.near_duplicates(table(spark, sf, "documents"), n=3, percent=85).drop("text_md5")


@query
def op6_induced_sorting(spark, sf):
    """What is left of every document without the 400-byte strings that occur twice or more."""
    done = suffixes.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[F.col("repeats")[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


ORACLES["op8_lsh_forest"] = r"""
WITH RECURSIVE
d AS (SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN LEN(w) = 0 THEN [] WHEN LEN(w) < 3 THEN [ARRAY_TO_STRING(w, ' ')]
                          ELSE LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LEN(w) - 1), lambda i: ARRAY_TO_STRING(w[i:i + 2], ' '))) END AS g FROM d),
u AS (SELECT doc_id, UNNEST(g) AS x FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, COUNT(*) AS n FROM u l JOIN u r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 85 * (LEN(x.g) + LEN(y.g) - n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, LEN(g) AS n_shingles, MIN(b) AS component_id, doc_id = MIN(b) AS kept FROM s JOIN r ON r.a = doc_id GROUP BY doc_id, g
"""


_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_stripes"] = rf"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, UNNEST(STRING_SPLIT_REGEX({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, LIST_FILTER(STRING_SPLIT_REGEX(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(w) - k + 2), lambda i: w[i:i + k - 1])) AS words FROM w, RANGE(1, 5) t(k) WHERE LEN(w) >= k),
f AS (SELECT lang, k, words, ARRAY_TO_STRING(words, ' ') AS phrase, COUNT(*)::HUGEINT AS a FROM g GROUP BY ALL),
t AS (SELECT lang, SUM(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
h AS (SELECT *, UNNEST(RANGE(1, k)) AS cut_at FROM c),
s AS (SELECT h.lang, h.phrase, h.a, cut_at, l.a AS l, r.a AS r, 2000000 * h.a // (l.a + r.a) AS score FROM h
      JOIN f l ON l.lang = h.lang AND l.phrase = ARRAY_TO_STRING(h.words[:cut_at], ' ') JOIN f r ON r.lang = h.lang AND r.phrase = ARRAY_TO_STRING(h.words[cut_at + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS
      (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > LEN(STRING_SPLIT(b.phrase, ' ')) AND 100 * c.a >= 80 * b.a AND CONTAINS(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""


@query
def op11_stripes(spark, sf):
    """The first 2000 collocations of every language."""
    return collocations.collocations(table(spark, sf, "documents"), "text", "lang", least=30, percent=80, scale=2_000_000, top=2000)


ORACLES["op12_pareto"] = r"""
WITH d AS (SELECT doc_id, source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, SUM(size)::HUGEINT AS source_size, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
q AS (SELECT *, 3 * source_size AS cap, (SUM(source_size) OVER ())::HUGEINT AS total,
        COALESCE(SUM(3 * source_size) OVER o, 0)::HUGEINT AS before, (SUM(weight) OVER () - COALESCE(SUM(weight) OVER o, 0))::HUGEINT AS weights_on
      FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, cap * weights_on < weight * (total - before) AS stops FROM q),
o AS (SELECT MAX(total) - COALESCE(SUM(cap) FILTER (stops), 0) AS words, SUM(weight) FILTER (NOT stops) AS weights FROM m),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (weight * words)::DOUBLE / weights::DOUBLE END AS target FROM m, o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
e AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, FLOOR(r.target + 0.5)::BIGINT - r.whole * r.source_size AS rest,
        (('0x' || SUBSTR(MD5('12:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source),
k AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN u / (1 - u) / (rest::DOUBLE / (source_size - rest)::DOUBLE * SQRT(size::DOUBLE)) END AS draw FROM e),
x AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY draw NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (whole * size + LEAST(GREATEST(rest - (upto - size), 0), size))::BIGINT AS taken FROM x
"""


@query
def op12_pareto(spark, sf):
    """How many words of every document a mix takes in which sources weigh 1, 2, 3, and again."""
    mixed = mixing.mix(table(spark, sf, "documents"), "doc_id", "text", "source", prefer=F.sqrt(F.col("size").cast("double")), seed=12)
    return mixed.select("doc_id", *[F.col("mix")[c].alias(c) for c in ("size", "source_size", "target", "taken")])


def _code_sql() -> str:
    """Every round as a step of its own: the parts' nearest entries, then the entries' new components."""
    flags = "LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, LIST_TRANSFORM(embedding, lambda x: FLOOR(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND {flags})",
        "p AS MATERIALIZED (SELECT vec_id, label, part, e[part * LEN(e) // 8 + 1:(part + 1) * LEN(e) // 8] AS e FROM v, RANGE(8) t(part))",
        "c0 AS MATERIALIZED (SELECT part, ROW_NUMBER() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    distance = "LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(p.e) + 1), lambda i: (p.e[i] - c.e[i]) * (p.e[i] - c.e[i])))"
    for i in range(codes.ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, ANY_VALUE(p.e) AS e, MIN({distance}::BIGINT * 16 + entry) AS found FROM p JOIN c{i} c USING (part) GROUP BY ALL)")
        if i < codes.ROUNDS:
            steps.append(f"s{i} AS (SELECT part, found % 16 AS entry, place, SUM(x)::BIGINT AS s, COUNT(*) AS n FROM (SELECT part, found, UNNEST(e) AS x, UNNEST(RANGE(LEN(e))) AS place FROM a{i}) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT part, entry, LIST((s - ((s % n) + n) % n) // n ORDER BY place) AS e FROM s{i} GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, COALESCE(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (part, entry))")
    last = codes.ROUNDS
    steps.append(f"r AS (SELECT vec_id, label, STRING_AGG(LPAD(FORMAT('{{:x}}', found % 16), 2, '0'), '' ORDER BY part) AS code, SUM(found // 16)::BIGINT AS error FROM a{last} GROUP BY ALL)")
    steps.append(f"h AS (SELECT SHA256(STRING_AGG(ARRAY_TO_STRING(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, SUM(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, h"


ORACLES["op13_limb_codes"] = _code_sql()


@query
def op13_limb_codes(spark, sf):
    """The product code of every vector with its error, after six rounds."""
    coded = codes.compress(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return coded.select(F.col("key").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
