"""Extraction from web pages, texts and API descriptions held in tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns over page source.
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]+>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
BODY = r"(?is)<body[^>]*>(.*?)</body>"
MEDIA_BLOCK = r"(?is)<(?:video|audio)\b[^>]*>.*?</(?:video|audio)\s*>"
PRICE = r"\$\s*([0-9][0-9\.,]*)"
YEAR = r"\b(19\d{2}|20\d{2})\b"


def _attribute_pattern(tag: str, attribute: str) -> str:
    return rf"(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"


def without_code(html: Column) -> Column:
    """Page source without scripts, styles and comments."""
    for pattern in (COMMENT, SCRIPT, STYLE):
        html = F.regexp_replace(html, pattern, "")
    return html


def _decoded(value: Column) -> Column:
    bare = F.regexp_replace(value, "^[\"']|[\"']$", "")
    for entity, letter in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return bare


def _attributes(html: Column, tag: str, attribute: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(_attribute_pattern(tag, attribute)), F.lit(1))
    return F.transform(found, _decoded)


def page_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, url) of every ``a`` with an ``href``."""
    return df.select(key, F.posexplode(_attributes(without_code(F.col(html)), "a", "href")).alias("pos", "url"))


def page_images(df: DataFrame, key: str, html: str) -> DataFrame:
    return df.select(key, F.posexplode(_attributes(without_code(F.col(html)), "img", "src")).alias("pos", "url"))


def page_media(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, url) of the sources inside ``video`` and ``audio``."""
    blocks = F.regexp_extract_all(without_code(F.col(html)), F.lit(MEDIA_BLOCK), F.lit(0))
    sources = F.flatten(F.transform(blocks, lambda b: _attributes(b, "source", "src")))
    return df.select(key, F.posexplode(sources).alias("pos", "url"))


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, TAG, " "), r"\s+", " "))


def page_summary(
    df: DataFrame, key: str, html: str, title_length: int | None = None, most_headings: int | None = None, heading_length: int | None = None
) -> DataFrame:
    """Title, headings, element counts and the plain text; whole unless a length or number is given."""
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    source = F.col(html)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title = cut(strip(F.regexp_extract(source, TITLE, 1)), title_length)
    headings = F.regexp_extract_all(source, F.lit(HEADING), F.lit(1))
    headings = headings if most_headings is None else F.slice(headings, 1, most_headings)
    count = lambda pattern: F.regexp_count(source, F.lit(pattern))
    return df.select(
        key,
        F.when(F.regexp_like(source, F.lit(TITLE)), title).alias("title"),
        F.transform(headings, lambda h: cut(strip(h), heading_length)).alias("headings"),
        count("(?i)<table").alias("tables"),
        count("(?i)<img").alias("images"),
        count("(?i)<a ").alias("links"),
        _plain(source).alias("text"),
    )


def page_text(df: DataFrame, key: str, html: str, max_length: int | None = None) -> DataFrame:
    """Visible text of the body; a snippet if ``max_length`` is given."""
    source = F.regexp_replace(F.regexp_replace(F.col(html), SCRIPT, ""), STYLE, "")
    body = F.when(F.regexp_like(source, F.lit(BODY)), F.regexp_extract(source, BODY, 1)).otherwise(source)
    text = _plain(body)
    return df.select(key, (text if max_length is None else F.substring(text, 1, max_length)).alias("text"))


# --- field extraction ------------------------------------------------------------------------

_STEP = re.compile(r"^(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([\w-]+)))?\]")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def parse_selector(selector: str) -> tuple[list[tuple[str | None, list[tuple[str, str | None]]]], str]:
    """Steps of (tag, attribute tests) from outer to inner, and the output: text, html or an attribute.

    Known forms: tag, .class, #id, [attr], [attr=value], their combinations, descendants by white
    space, ``//tag[@attr="value"]`` paths, with ::text, ::html or ::attr(name) at the end."""
    css, _, pseudo = selector.partition("::")
    pseudo = pseudo or "text"
    css = css.strip()
    if css.startswith("//"):
        path, _, tail = css.partition("/@")
        pseudo = f"attr({tail})" if tail else pseudo
        path = path.removesuffix("/text()")
        css = " ".join(re.sub(r"\[@", "[", step) for step in re.split(r"/+", path) if step)
    steps = []
    for word in css.split():
        match = _STEP.match(word)
        if not match:
            raise ValueError(f"selector {selector!r} is not supported")
        tests: list[tuple[str, str | None]] = []
        for kind, name, attribute, *values in _PART.findall(match["rest"] or ""):
            if kind:
                tests.append(("class" if kind == "." else "id", name))
            else:
                tests.append((attribute, next((v for v in values if v), None)))
        tag = match["tag"]
        steps.append((None if tag in (None, "*") else tag.lower(), tests))
    return steps, pseudo


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(_Node(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        at = self.here
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.here = at.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _text(node) -> str:
    out, left = [], [node]
    while left:
        at = left.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            left.extend(reversed(at.children))
    return "".join(out)


def _source(node) -> str:
    out, left = [], [(node, False)]
    while left:
        at, done = left.pop()
        if done:
            out.append(at)
        elif isinstance(at, str):
            out.append(escape(at, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in at.attrs.items())
            out.append(f"<{at.tag}{attrs}>")
            if at.tag not in _VOID:
                left.append((f"</{at.tag}>", True))
                left.extend((c, False) for c in reversed(at.children))
    return "".join(out)


def _below(node):
    left = list(reversed(node.children))
    while left:
        at = left.pop()
        if not isinstance(at, str):
            yield at
            left.extend(reversed(at.children))


def _fits(node, step) -> bool:
    tag, tests = step
    if tag is not None and node.tag != tag:
        return False
    for name, value in tests:
        have = node.attrs.get(name)
        if name not in node.attrs:
            return False
        if name == "class" and value is not None:
            if value not in (have or "").split():
                return False
        elif value is not None and have != value:
            return False
    return True


def _matches(root, steps):
    """Nodes under ``root`` that fit the last step and have ancestors fitting the earlier ones."""
    for node in _below(root):
        if not _fits(node, steps[-1]):
            continue
        rest, at = len(steps) - 2, node.parent
        while rest >= 0 and at is not None:
            if _fits(at, steps[rest]):
                rest -= 1
            at = at.parent
        if rest < 0:
            yield node


def _values(root, selector) -> list[str]:
    steps, pseudo = selector
    found = list(_matches(root, steps))
    if pseudo.startswith("attr("):
        return [n.attrs[pseudo[5:-1]] for n in found if n.attrs.get(pseudo[5:-1]) is not None]
    if pseudo == "html":
        return [_source(n) for n in found]
    texts = [_text(n) for n in found]
    return [t.strip() for t in texts if t]


def extract_fields(df: DataFrame, key: str, html: str, rules: Mapping[str, str | Mapping]) -> DataFrame:
    """Fields by selector: lists of text, or lists of maps for ``{"root": …, "fields": {…}}`` rules."""
    flat = {name: parse_selector(rule) for name, rule in rules.items() if isinstance(rule, str)}
    nested = {
        name: (parse_selector(rule["root"]), {f: parse_selector(s) for f, s in rule["fields"].items()})
        for name, rule in rules.items()
        if not isinstance(rule, str)
    }
    schema = T.StructType([df.schema[key]])
    for name in rules:
        item = T.StringType() if name in flat else T.MapType(T.StringType(), T.StringType())
        schema = schema.add(name, T.ArrayType(item))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {name: [] for name in rules}
            for source in batch[html]:
                builder = _Builder()
                builder.feed(source or "")
                for name, selector in flat.items():
                    out[name].append(_values(builder.root, selector))
                for name, ((steps, _), fields) in nested.items():
                    items = []
                    for node in _matches(builder.root, steps):
                        items.append({f: next(iter(_values(node, s)), None) for f, s in fields.items()})
                    out[name].append(items)
            yield pd.DataFrame({key: batch[key], **out})

    return df.select(key, html).mapInPandas(extract, schema)


# --- texts -------------------------------------------------------------------------------------


def text_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, characters, words of a text; rows and columns if it is read as CSV."""
    value = F.col(text)
    lines = F.size(F.split(value, "\n"))
    words = F.size(F.regexp_extract_all(value, F.lit(r"\S+"), F.lit(0)))
    header = F.substring_index(value, "\n", 1)
    return df.select(
        key,
        lines.alias("line_count"),
        F.length(value).alias("char_count"),
        words.alias("word_count"),
        F.size(F.split(header, ",")).alias("csv_columns"),
    )


def dedup_by_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row per distinct content (SHA-256) with its first key and number of copies."""
    return (
        df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(content).alias("bytes"))
        .groupBy("hash")
        .agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"))
    )


def content_totals(df: DataFrame, kind: str, content: str) -> DataFrame:
    """Stored rows, distinct contents and bytes per kind."""
    return (
        df.select(kind, F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(content).cast("long").alias("bytes"))
        .groupBy(kind, "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
        .groupBy(kind)
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_contents"), F.sum("bytes").alias("unique_bytes"))
    )


def gc(store: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """The store without the keys that are no longer kept."""
    return store.join(keep.select(key).distinct(), key, "left_semi")


# --- API descriptions --------------------------------------------------------------------------

HTTP_METHODS = ("get", "post", "put", "delete", "patch")


def spec_endpoints(df: DataFrame, key: str, spec: str, source_url: str | None = None) -> DataFrame:
    """Endpoints of OpenAPI 3 and Swagger 2 texts: path, method, summary, whether auth is required, and
    the API's title, version, base URL and kind of auth. Other texts give no endpoints; ``spec_errors`` names them."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    field = lambda m, name: F.try_element_at(m, F.lit(name))
    top = df.select("*", as_map(F.col(spec)).alias("_s"))
    is_v3, is_v2 = field("_s", "openapi").isNotNull(), field("_s", "swagger").isNotNull()
    info = as_map(field("_s", "info"))
    server = field(F.get(F.from_json(field("_s", "servers"), "array<map<string,string>>"), F.lit(0)), "url")
    scheme = F.coalesce(F.get(F.from_json(field("_s", "schemes"), "array<string>"), F.lit(0)), F.lit("https"))
    host = field("_s", "host")
    v2_url = F.when(
        F.coalesce(host, F.lit("")) != "",
        F.concat(scheme, F.lit("://"), host, F.coalesce(field("_s", "basePath"), F.lit(""))),
    )
    base = F.nullif(F.coalesce(F.when(is_v3, server).otherwise(v2_url), F.lit("")), F.lit(""))
    if source_url:
        base = F.coalesce(base, F.nullif(F.regexp_extract(source_url, r"^([A-Za-z][\w+.-]*://[^/?#]+)", 1), F.lit("")))
    schemes = F.when(is_v3, field(as_map(field("_s", "components")), "securitySchemes")).otherwise(
        field("_s", "securityDefinitions")
    )
    first = as_map(F.get(F.map_values(as_map(schemes)), F.lit(0)))
    kind = F.lower(field(first, "type"))
    auth = (
        F.when(kind == "apikey", "ApiKey")
        .when((kind == "http") & (field(first, "scheme") == "bearer"), "Bearer")
        .when(kind == "oauth2", "OAuth2")
        .otherwise(F.coalesce(kind, F.when(first.isNotNull(), "").otherwise("none")))
    )
    some = lambda c: F.coalesce(F.size(F.from_json(c, "array<string>")) > 0, F.lit(False))
    heads = top.where(is_v3 | is_v2).select(
        key,
        F.coalesce(field(info, "title"), F.lit("Unknown API")).alias("title"),
        F.coalesce(field(info, "version"), F.lit("1.0")).alias("version"),
        F.coalesce(base, F.lit("")).alias("base_url"),
        auth.alias("auth_type"),
        some(field("_s", "security")).alias("_all"),
        F.explode(as_map(field("_s", "paths"))).alias("path", "_methods"),
    )
    calls = heads.select("*", F.explode(as_map(F.col("_methods"))).alias("_method", "_details"))
    details = as_map(F.col("_details"))
    return calls.where(F.lower("_method").isin(*HTTP_METHODS)).select(
        key,
        "title",
        "version",
        "base_url",
        "auth_type",
        "path",
        F.upper("_method").alias("method"),
        F.coalesce(field(details, "summary"), F.lit("")).alias("summary"),
        (F.col("_all") | some(field(details, "security"))).alias("auth_required"),
    )


def spec_errors(df: DataFrame, key: str, spec: str) -> DataFrame:
    """(key, error) of the texts that ``spec_endpoints`` reads nothing from."""
    top = F.from_json(F.col(spec), "map<string,string>")
    named = lambda name: F.try_element_at(top, F.lit(name)).isNotNull()
    error = (
        F.when(F.col(spec).isNull(), "no text")
        .when(F.get_json_object(F.col(spec), "$").isNull() | top.isNull(), "no JSON object")
        .when(~F.coalesce(named("openapi") | named("swagger"), F.lit(False)), "unknown API description format")
        .when(F.try_element_at(top, F.lit("paths")).isNull(), "no paths")
    )
    return df.select(key, error.alias("error")).where(F.col("error").isNotNull())


# --- page metadata -----------------------------------------------------------------------------


def meta_property(html: Column, name: str) -> Column:
    """Content of ``<meta property=…>`` with the attributes in either order, trimmed."""
    quoted = re.escape(name)
    value = r"['\"]([^'\"]+)['\"]"
    orders = (
        rf"(?i)<meta[^>]+property=['\"]{quoted}['\"][^>]+content={value}",
        rf"(?i)<meta[^>]+content={value}[^>]+property=['\"]{quoted}['\"]",
    )
    found = [F.when(F.regexp_like(html, F.lit(p)), F.trim(F.regexp_extract(html, p, 1))) for p in orders]
    return F.coalesce(*found)


def page_meta(df: DataFrame, key: str, html: str, properties: Mapping[str, str], description: str = "og:description") -> DataFrame:
    """Named meta properties, price and year out of the description, and the distinct image URLs in order.

    The digits of an amount are no year."""
    source = F.col(html)
    about = meta_property(source, description)
    picked = lambda text, p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    price = picked(about, PRICE)
    head = F.when(meta_property(source, "og:image").isNotNull(), F.array(meta_property(source, "og:image"))).otherwise(F.array())
    images = F.concat(head.cast("array<string>"), _attributes(source, "img", "src"))
    absolute = F.transform(images, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return df.select(
        key,
        *[meta_property(source, prop).alias(name) for name, prop in properties.items()],
        F.concat(price, F.lit(" USD")).alias("price"),
        picked(F.regexp_replace(about, PRICE, " "), YEAR).cast("int").alias("year"),
        F.array_distinct(F.filter(absolute, lambda u: u != "")).alias("images"),
    )
