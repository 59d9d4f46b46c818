"""Phrase collocations by the stripes pattern.

Every prefix of one to three words keys an associative counter of the words that follow it, its stripe; the
empty word stands for the end of a piece. Tasks build stripes over slices of the corpus, and stripes of one
prefix are merged elementwise. The merged stripes hold all that scoring needs: an entry is the count of a
phrase (prefix, next word), the sum of a one-word stripe is the count of its word, and the largest entry of a
phrase's stripe is the most that a longer phrase to its right keeps of it; the same maximum over entries with
equal last words is that to its left. A phrase inside a longer one by two words lies inside one between the
two, which is at least as frequent, so one word to either side decides.

Scale:

* A stripe grows with the vocabulary, so it is cut into ``BANDS`` by a hash of the next word; a band of a
  prefix has a place of its own, and each place is one task. A prefix with a third of all words is so
  spread over as many tasks as it has bands. A row is what one slice has for one place.
* Stripes of two and three words are built in a second pass, and only of frequent pairs: a phrase of three words
  can be frequent only if both its pairs are. The tasks know the frequent pairs by a bitmap of a fixed size
  (``FILTER_BITS``). It can say yes to a rare pair, which costs work, never no to a frequent one, so counts are
  exact at any size. Only the bitmap passes the driver.
* What follows works on frequent phrases with joins and aggregates of Spark.

Pairs are told by 64-bit hashes in the bitmap alone; all counts are of the words themselves.

Null texts are empty, a null group is ``und``. Empty texts and texts of separators have no words. Very long
texts are read whole, repeated rows count again, an empty table gives no rows. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.order import with_index

MAX_WORDS, BANDS = 4, 64
#: Bytes of text whose stripes are built together: what a task holds at once, but for a longer single text.
SLICE_BYTES = 12 << 20
#: Entries that a merging task takes in before it adds them up.
MERGE_ENTRIES = 2_000_000
#: 32,768 bits for each row of the bitmap, which is the block of Spark's bitmap functions.
FILTER_BLOCKS, BLOCK_BITS = 1024, 32_768
FILTER_BITS = FILTER_BLOCKS * BLOCK_BITS
UNKNOWN = "und"


def _byte_table() -> bytes:
    """Lower-cases A-Z, and makes every mark between pieces a line feed and a tab a space. All of them are
    ASCII, so bytes of other characters stay as they are."""
    table = bytearray(range(256))
    table[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for mark in b".,;:!?\x0a\x0b\x0c\x0d":
        table[mark] = 0x0A
    table[0x09] = 0x20
    return bytes(table)


BYTE_TABLE = _byte_table()


class Words:
    """The words of some texts in order: codes into ``known``, and the piece each lies in."""

    def __init__(self, texts: pa.LargeStringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
        chars = np.frombuffer(bytes(raw).translate(BYTE_TABLE), np.uint8)
        inside = (chars != 0x20) & (chars != 0x0A)
        text_starts = offsets[:-1] - offsets[0]
        text_starts = text_starts[text_starts < len(chars)]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[text_starts] = inside[text_starts]
        breaks = chars == 0x0A
        breaks[text_starts] = True
        self.piece = np.cumsum(breaks, dtype=np.int32)[new]
        letters = chars[inside]
        ends = np.append(np.flatnonzero(new[inside]), len(letters))
        words = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.known = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.known.to_pylist()), np.uint64, len(self.known))

    def follows(self, words: int) -> np.ndarray:
        """Places from which so many words lie in one piece."""
        last = max(len(self.code) - words + 1, 0)
        return np.flatnonzero(self.piece[:last] == self.piece[words - 1 :][:last])


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


STRIPES = pa.schema(
    [
        ("place", pa.int32()),
        ("lang", pa.string()),
        ("prefix", pa.list_(pa.string())),
        ("size", pa.list_(pa.int32())),
        ("next", pa.list_(pa.string())),
        ("n", pa.list_(pa.int64())),
    ]
)
STRIPES_DDL = "place int, lang string, prefix array<string>, size array<int>, next array<string>, n array<long>"


def _laid_flat(lang: str, prefixes: pa.Array, prefix: np.ndarray, following: pa.Array, n: np.ndarray, prefix_hash: np.ndarray, next_hash: np.ndarray, places: int) -> pa.RecordBatch:
    """Entries (number of the prefix, next word, count), ordered by prefix, as one row per place: the stripes'
    prefixes and sizes, and all their entries one behind the other."""
    place = (mixed(prefix_hash[prefix], next_hash % np.uint64(BANDS)) % np.uint64(places)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    place, prefix, n = place[order], prefix[order], n[order]
    row = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    stripe = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (prefix[1:] != prefix[:-1])))
    in_row, in_stripe = np.append(row, len(place)), np.append(stripe, len(place))
    of_row = np.searchsorted(in_stripe, in_row).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(of_row), prefixes.take(pa.array(prefix[stripe])).cast(pa.string())),
        pa.ListArray.from_arrays(pa.array(of_row), pa.array(np.diff(in_stripe).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(in_row.astype(np.int32)), following.take(pa.array(order)).cast(pa.string())),
        pa.ListArray.from_arrays(pa.array(in_row.astype(np.int32)), pa.array(n)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(place[row]), pa.array([lang] * len(row), pa.string()), *lists], schema=STRIPES)


def first_stripes(lang: str, words: Words, places: int) -> Iterator[pa.RecordBatch]:
    """The stripes of single words; every occurrence of a word is in its stripe, at the end of a piece under the
    empty word."""
    if not len(words.code):
        return
    known = pa.concat_arrays([words.known, pa.array([""], pa.large_string())])
    end, base = len(words.known), len(known)
    following = np.full(len(words.code), end, np.int64)
    at = words.follows(2)
    following[at] = words.code[at + 1]
    key, n = np.unique(words.code * base + following, return_counts=True)
    prefix, following = np.divmod(key, base)
    hashes = np.append(words.hashes(), np.uint64(0))
    yield _laid_flat(lang, known, prefix, known.take(pa.array(following)), n, hashes, hashes[following], places)


def longer_stripes(lang: str, words: Words, places: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The stripes of two and three words, made of pairs that may be frequent."""
    at = words.follows(2)
    if not len(at):
        return
    hashes, base = words.hashes(), len(words.known)
    pair, of_pair = np.unique(words.code[at] * base + words.code[at + 1], return_inverse=True)
    pair_hash = mixed(hashes[pair // base], hashes[pair % base])
    bit = mixed(np.full(1, xxhash.xxh3_64_intdigest(lang), np.uint64), pair_hash) % np.uint64(FILTER_BITS)
    kept = np.flatnonzero((frequent[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
    number = np.full(len(pair), -1, np.int64)
    number[kept] = np.arange(len(kept))
    phrase = np.full(len(words.code), -1, np.int64)
    phrase[at] = number[of_pair]
    good = phrase >= 0
    space = pa.scalar(" ", pa.large_string())
    names = pc.binary_join_element_wise(words.known.take(pa.array(pair[kept] // base)), words.known.take(pa.array(pair[kept] % base)), space)
    phrase_hash = pair_hash[kept]
    for length in range(3, MAX_WORDS + 1):
        at = words.follows(length)
        at = at[(phrase[at] >= 0) & good[at + length - 2]]
        if not len(at):
            return
        key, of_key, n = np.unique(phrase[at] * base + words.code[at + length - 1], return_inverse=True, return_counts=True)
        prefix, following = np.divmod(key, base)
        last = words.known.take(pa.array(following))
        yield _laid_flat(lang, names, prefix, last, n, phrase_hash, hashes[following], places)
        names, phrase_hash = pc.binary_join_element_wise(names.take(pa.array(prefix)), last, space), mixed(phrase_hash[prefix], hashes[following])
        phrase = np.full(len(words.code), -1, np.int64)
        phrase[at] = of_key


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.LargeStringArray]]:
    """(group, texts) of a batch, a slice's bytes at a time."""
    for batch in batches:
        text = batch.column(0).cast(pa.large_string())
        lang = batch.column(1).dictionary_encode()
        codes = lang.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(lang.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            upto = np.cumsum(pc.binary_length(text.take(pa.array(rows))).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1
            for part in np.split(rows, cuts):
                yield name, text.take(pa.array(part))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Elementwise sums of the stripes of a place: (lang, prefix, next, n)."""
    parts, entries = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(parts).group_by(["lang", "prefix", "next"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "prefix", "next", "n"])

    for batch in batches:
        prefix, size, following, n = (batch.column(c).flatten() for c in range(2, 6))
        entry = np.repeat(np.arange(len(prefix), dtype=np.int64), size.to_numpy(zero_copy_only=False))
        of_row = np.repeat(np.arange(len(batch), dtype=np.int64), pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False))
        columns = [batch.column(1).take(pa.array(of_row)), prefix.take(pa.array(entry)), following, n]
        parts.append(pa.table(columns, names=["lang", "prefix", "next", "n"]))
        entries += len(n)
        if entries > MERGE_ENTRIES:
            parts = [summed()]
            entries = len(parts[0])
    if parts:
        yield summed()


ENTRIES_DDL = "lang string, prefix string, next string, n long"


def _stripes(texts: DataFrame, least: int, frequent: Broadcast | None) -> DataFrame:
    """Entries of the merged stripes with a count of ``least`` or more. In the first pass (no bitmap) also the
    stripes' sums, a row for each band, with a null ``next``."""
    places = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        for lang, part in _slices(batches):
            words = Words(part)
            yield from first_stripes(lang, words, places) if bits is None else longer_stripes(lang, words, places, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for merged in _merge(batches):
            found = merged.filter((pc.field("n") >= least) & (pc.field("next") != ""))
            yield from found.to_batches()
            if frequent is None:
                sums = merged.group_by(["lang", "prefix"], use_threads=False).aggregate([("n", "sum")])
                nothing = pa.nulls(len(sums), pa.string())
                yield from pa.table([sums["lang"], sums["prefix"], nothing, sums["n_sum"]], names=found.column_names).to_batches()

    laid = texts.mapInArrow(build, STRIPES_DDL)
    return laid.repartitionById(places, F.col("place")).mapInArrow(merge, ENTRIES_DDL)


def _pair_filter(pairs: DataFrame) -> bytes:
    """The bitmap of (lang, prefix, next): at most ``FILTER_BLOCKS`` blocks of fixed size reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(column: pa.Array) -> np.ndarray:
            return np.fromiter(map(xxhash.xxh3_64_intdigest, column.to_pylist()), np.uint64, len(column))

        for batch in batches:
            pair = mixed(hashed(batch.column("prefix")), hashed(batch.column("next")))
            bit = mixed(hashed(batch.column("lang")), pair) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], ["bit"])

    marked = pairs.mapInArrow(bits, "bit long")
    block, place = F.floor(F.col("bit") / BLOCK_BITS).cast("int"), F.col("bit") % BLOCK_BITS
    blocks = marked.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))
    filled = bytearray(FILTER_BITS // 8)
    for row in blocks.collect():
        filled[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = row.bits
    return bytes(filled)


def phrases(docs: DataFrame, text: str, group: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases, (lang, prefix, next, phrase, words, a), and the words, (lang, phrase, n)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    first = freeze(_stripes(texts, least, None))
    pairs = first.where("next IS NOT NULL")
    words = first.where("next IS NULL").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("n"))
    held = spark.sparkContext.broadcast(_pair_filter(pairs))
    longer = freeze(_stripes(texts, least, held))
    phrase = F.concat_ws(" ", "prefix", "next")
    found = pairs.union(longer).select("lang", "prefix", "next", phrase.alias("phrase"), F.size(F.split("prefix", " ")).alias("prefix_words"), F.col("n").alias("a"))
    return found.withColumn("words", F.col("prefix_words") + 1).drop("prefix_words"), freeze(words)


def _wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = 30, percent: int = 80, scale: int = 2_000_000, top: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of two to four words that occur ``least`` times or more
    in their group and of which no longer phrase keeps ``percent`` of 100 occurrences.

    The score is floor(scale * a / (l + r)) for the cut into two parts that gives the least, ties to the
    earliest; products are decimals of 38 digits. Ranked per group by score and ``a``, descending, then by the
    bytes of the phrase; with ``top``, only so many ranks."""
    found, words = phrases(docs, text, group, least)
    counts = words.where(F.col("n") >= least).unionByName(found.where(F.col("words") < MAX_WORDS).select("lang", "phrase", F.col("a").alias("n")))

    parts = F.split("phrase", " ")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(F.concat_ws(" ", F.slice(parts, 1, k)).alias("left"), F.concat_ws(" ", F.slice(parts, k + 1, 4)).alias("right"))))
    cuts = found.select("lang", "phrase", "a", cut.alias("k", "cut")).select("lang", "phrase", "a", "k", "cut.left", "cut.right")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    score = (_wide(F.col("a")) * F.lit(scale)).cast("decimal(38,0)")
    scored = cuts.withColumn("score", F.call_function("div", score, _wide(F.col("l")) + _wide(F.col("r"))))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), least_cut).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    onward = found.where(F.col("words") > 2)
    inside = onward.select("lang", F.col("prefix").alias("phrase"), "a").union(onward.select("lang", F.array_join(F.slice(parts, 2, 3), " "), "a"))
    keeps = inside.groupBy("lang", "phrase").agg(F.max("a").alias("kept"))
    swallowed = (_wide(F.col("kept")) * 100) >= (_wide(F.col("a")) * percent)
    left = best.join(keeps, ["lang", "phrase"], "left").where(F.coalesce(~swallowed, F.lit(True))).drop("kept")

    ranked = with_index(left, [F.desc("score"), F.desc("a"), F.asc("phrase")], ["lang"], "rank").withColumn("rank", F.col("rank") + 1)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

