"""WARC archives with a two-level capture index.

Writing: one record per page, as text files of Spark's own writer whose line end is the record end, so a failed
task leaves nothing behind. Of equal payloads of some length, one page holds the payload; the others are revisit
records that refer to it.

Index: entries (reversed-host key, page, file, offset, length, …) sorted over the cluster by key and cut into
blocks of a few thousand lines, each compressed on its own. The directory above holds only the first key of each
block. A lookup takes the range of the key, bisects the directory, unpacks one block, bisects its lines, and then
reads one byte range of one archive.

The folder has to be one that pyarrow can open on every executor (a shared mount, or an object store it knows).

Null payloads are empty. Null addresses are written without a target and indexed under an empty key. Repeated
rows are records of their own. A row without a page number cannot be referred to: its number is null throughout.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT = 1000  # bytes of the shortest payload that is worth a revisit record
RECORDS_PER_FILE = 5000
LINES_PER_BLOCK = 3000
_END = "\r\n\r\n"
_CONTROLS = re.compile(r"[\x00-\x20\x7f]")
_FILE = re.compile(r"^file:/+")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, page: str, payload: str, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``_digest``, ``_bytes`` and ``_refers``: the page that holds an equal payload, null if this one does.

    Only payloads met twice go into the table of holders. It is written and read back, so Spark knows its
    true size and itself chooses between broadcasting it and a shuffle whose hot keys it may split."""
    body = F.coalesce(payload, F.lit(""))
    judged = pages.withColumns({"_digest": F.sha1(body), "_bytes": F.octet_length(body).cast("long")})
    long_ones = judged.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.max(page).alias("_holder"), F.count(F.lit(1)).alias("_n"))
    long_ones.where("_n > 1 AND _holder IS NOT NULL").select("_digest", "_holder").write.parquet(f"{folder}/holders")
    holders = pages.sparkSession.read.parquet(f"{folder}/holders")
    refers = F.when((F.col("_bytes") >= least) & (F.col(page) < F.col("_holder")), F.col("_holder"))
    return judged.join(holders, "_digest", "left").withColumn("_refers", refers).drop("_holder")


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archives under ``folder``/archives. Of equal payloads of at least ``least`` bytes, the page
    with the largest number holds the payload."""
    rows = decide(pages, page, payload, folder, least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    body = F.when(F.col("_refers").isNull(), F.coalesce(payload, F.lit(""))).otherwise("")
    # Nothing in an address may end a header line; url_encode of the whole would hide it, so only controls go.
    target = F.regexp_replace(F.regexp_replace(F.col(url), "%", "%25"), r"[\x00-\x20\x7f]", "%20")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("_refers").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.coalesce(urn(F.col(page)), F.lit("<urn:page:none>"))),
        line("WARC-Target-URI", target),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        line("WARC-Refers-To", urn(F.col("_refers"))),
        line("WARC-Profile", F.when(F.col("_refers").isNotNull(), F.lit(_PROFILE))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Bytes", F.col("_bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{folder}/archives")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _spans(data: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, headers) of every record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:head].decode().split("\r\n")[1:])
        end = head + 4 + int(fields["Content-Length"])
        yield at, end - at, fields
        at = end + len(_END)


def key_of(url: str | None) -> str:
    """Reversed host, then the rest: ``http://www.a.com/x`` becomes ``com,a,www)/x``. Controls become blanks."""
    url = _CONTROLS.sub(" ", url or "")
    if "://" not in url:
        return url
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def sort_key(url: str | None, page: int | None) -> str:
    """Key and page number as one text that sorts as the pair does."""
    return key_of(url) + " " + ("" if page is None else f"{page + (1 << 63):020d}")


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _longs(values: list[int | None]) -> pd.Series:
    return pd.Series(values, dtype="Int64")


def build_index(spark: SparkSession, folder: str, lines_per_block: int = LINES_PER_BLOCK) -> None:
    """Read the archives through and write ``folder``/blocks: one row per block with its range (a number that
    follows the keys), its place in the range, its first key, and its compressed lines."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for offset, length, fields in _spans(data):
                    url = fields.get("WARC-Target-URI")
                    rows.append((sort_key(None if url is None else unquote(url), _page(fields["WARC-Record-ID"])), file, offset, length))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0

        def packed():
            text = "\n".join("\t".join(line) for line in held)
            return pd.DataFrame([(held[0][0], number, len(held), zlib.compress(text.encode()))], columns=["first", "number", "lines", "data"])

        for frame in frames:
            for key, file, offset, length in frame.itertuples(index=False, name=None):
                held.append((key, file, str(offset), str(length)))
                if len(held) == lines_per_block:
                    yield packed()
                    held, number = [], number + 1
        if held:
            yield packed()

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/archives").select("path", "content")
    found = archives.mapInPandas(entries, "key string, file string, offset long, length long")
    ordered = found.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    made = ordered.mapInPandas(blocks, "first string, number int, lines int, data binary")
    made.withColumn("range", F.spark_partition_id()).write.parquet(f"{folder}/blocks")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, url: str = "url", page: str = "page_id") -> DataFrame:
    """(key, file, offset, length) of every record of the wanted (address, page) pairs.

    The driver holds one key per range, of which there are as many as shuffle partitions. Each range is one
    group: its share of the wanted keys and its compressed blocks; one block is open at a time."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    firsts = sorted((r["first"], r["range"]) for r in blocks.groupBy("range").agg(F.min("first").alias("first")).collect())
    starts, ranges = [f for f, _ in firsts], [r for _, r in firsts]

    @F.pandas_udf("key string, ranges array<int>")
    def route(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        keys = [sort_key(u, None if pd.isna(p) else int(p)) for u, p in zip(urls, pages, strict=True)]
        # Equal keys may end one range, fill others and begin the next: from the last range that begins before
        # the key to the last one that begins with it or before.
        spans = [(max(bisect_left(starts, k) - 1, 0), max(bisect_right(starts, k), 1)) for k in keys]
        return pd.DataFrame({"key": keys, "ranges": [ranges[a:b] for a, b in spans]})

    # Numbers go as text: a column with nulls would turn to doubles on the way.
    routed = wanted.select(route(F.col(url), F.col(page).cast("string")).alias("k"))
    keys = routed.select("k.key", F.explode("k.ranges").alias("range")).distinct()

    def find(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("number")
        directory, data = list(have["first"]), list(have["data"])
        rows, opened = [], (-1, [], [])
        for key in sorted(want["key"]):
            at = max(bisect_left(directory, key) - 1, 0)
            while at < len(data) and (directory[at] <= key):
                if opened[0] != at:
                    lines = zlib.decompress(data[at]).decode().split("\n")
                    opened = (at, [x.split("\t", 1)[0] for x in lines], lines)
                for line in opened[2][bisect_left(opened[1], key) : bisect_right(opened[1], key)]:
                    _, file, offset, length = line.split("\t")
                    rows.append((key, file, int(offset), int(length)))
                at += 1
        return pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    return keys.groupBy("range").cogroup(blocks.groupBy("range")).applyInPandas(find, "key string, file string, offset long, length long")


RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload string"


def read(hits: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the byte range of every hit. A response's digest and size are taken anew from its payload, and a
    payload that does not fit its header is an error; a revisit's are those its header gives for the payload
    it stands for, and its payload is null."""

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, opened = None, None
        for frame in frames:
            for begin in range(0, len(frame), 200):
                rows = []
                for file, offset, length in frame.iloc[begin : begin + 200][["file", "offset", "length"]].itertuples(index=False, name=None):
                    if file != name:
                        system, path = fs.FileSystem.from_uri(_FILE.sub("file:///", file))
                        name, opened = file, system.open_input_file(path)
                    opened.seek(offset)
                    fields, body = parse(opened.read(length))
                    size, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response:
                        if (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                            raise ValueError(f"{file} at {offset}: the payload does not fit its header")
                    url, refers = fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To")
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(refers) if refers else None, size, digest, None if url is None else unquote(url), body.decode() if with_payload and response else None))
                out = pd.DataFrame(rows, columns=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"])
                yield out.assign(page_id=_longs([r[0] for r in rows]), refers_to=_longs([r[2] for r in rows]))

    # A file holds a bounded number of records, so the file may decide the task.
    return hits.select("file", "offset", "length").repartition(F.xxhash64("file")).sortWithinPartitions("file", "offset").mapInPandas(records, RECORD)
