"""Removal of repeated byte strings by suffix arrays.

Every byte that lies in a ``width``-byte string which also starts anywhere else, in the same document or in
another, is removed; all occurrences go.

1. Equal texts become one row with a count. These rows are bucketed by text once, in the shared folder; later
   steps join to them without moving texts again.
2. Each window of ``width`` bytes picks the smallest hash among its ``gram``-byte strings. Equal windows pick
   equal grams at equal places, so windows are dealt by the gram they pick: a run of windows that pick the same
   occurrence is one segment. Only grams that occur twice matter. Equal segments count as one class; a class
   met twice is repeated as a whole.
3. Equal windows also share, at the same distance from the gram, one of a few cores, strings a little shorter than
   a window. Segments none of whose cores another has hold no repeated window and go no further.
4. The distinct segments of a gram that are left go to one shard. A gram's array is induced: suffixes are classified,
   leftmost-smaller substrings are sorted by induction and named, recursively until the names differ, and the
   array is induced from their order, in linear time. Permuted common prefixes along text order then give the
   windows that a neighbour in the array shares. Every gram of a shard has an array of its own, for no window is
   equal to one of another gram: small arrays stay in the processor's caches, which halves the time of a byte.
5. A gram whose distinct segments are too large for one shard is taken apart further: its windows are counted one
   by one by a 128-bit hash, with partial sums, so a hot gram is no one task's work.

Null texts count as empty; texts shorter than ``width`` lose nothing. Matches never cross documents.

The same steps also find repeated runs of words, whatever their bytes: a word (what white space parts) becomes a
symbol of 8 bytes, the hash of its bytes, and all places and lengths count symbols.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze, shared_folder

WIDTH, GRAM, CORES = 400, 64, 8
#: Words of a gram where words are counted, and bytes of a word's symbol.
WORD_GRAM, WORD_BYTES = 12, 8
#: Bytes of one shard's arrays, and of a gram's segments beyond which its windows are counted one by one.
SHARD_BYTES, GRAM_BYTES = 1_000_000, 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TYPES = {1: np.uint8, WORD_BYTES: np.uint64}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)


class Words:
    """Words as symbols; the symbols of common words are kept."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def __call__(self, raw: bytes) -> bytes:
        if len(self.known) > self.most:
            self.known = {}
        known, out = self.known, []
        for word in raw.split():
            symbol = known.get(word)
            if symbol is None:
                symbol = known[word] = hashlib.blake2b(word, digest_size=WORD_BYTES).digest()
            out.append(symbol)
        return b"".join(out)


def word_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of ranges of words."""
    places = [m.span() for m in _WORD.finditer(raw)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` symbols from every position on, built from those of its halves."""
    done, width, rest = None, 0, gram
    part, span, factor = _BYTES[data] if data.dtype == np.uint8 else data, 1, int(_MIX)
    while rest:
        if rest & 1:
            if done is None:
                done, width = part, span
            else:
                m = len(data) - width - span + 1
                done = done[:m] * np.uint64(factor) + part[width : width + m]
                width += span
        rest >>= 1
        if rest:
            m = len(part) - span
            part = part[:m] * np.uint64(factor) + part[span : span + m]
            factor = factor * factor % (1 << 64)
            span *= 2
    return _mixed(done)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima inside blocks, from both ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(texts: list[bytes], width: int, gram: int, unit: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows that pick the same occurrence of a gram: number of the text, first window's place in
    it and in the joined texts, number of windows, hash of the gram, its distance from the first window. All
    are counted in symbols of ``unit`` bytes."""
    sizes = np.array([len(t) // unit for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), _TYPES[unit])
    if len(data) < width:
        return (np.empty(0, np.int64),) * 6
    hashes = gram_hashes(data, gram)
    keyed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    picked = (sliding_min(keyed, width - gram + 1) & _LOW).astype(np.int64)
    full = sizes >= width
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, (ends - sizes)[full], 1)
    np.add.at(steps, ends[full] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(steps[:-1]))
    gram_at = picked[at]
    first = np.flatnonzero(np.concatenate([[True], (gram_at[1:] != gram_at[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    owner = np.searchsorted(ends, start, side="right")
    return owner, start - (ends - sizes)[owner], start, count, hashes[gram_at[first]].view(np.int64), gram_at[first] - start


def core_places(width: int, gram: int, cores: int) -> list[tuple[int, int]]:
    """(bytes before, bytes after) the gram of every core. Two equal windows agree on l bytes before and r after
    their gram, l + r = width - gram at least; each value of l lies in one step of the cores."""
    around = width - gram
    step = max(1, -(-around // cores))
    return [(before, max(0, around - before - step + 1)) for before in range(0, around + 1, step)]


def suffix_array(s: list[int], symbols: int) -> list[int]:
    """Suffix array of ``s``, whose last symbol is 0 and occurs once, by induced sorting."""
    n = len(s)
    if n == 1:
        return [0]
    a = np.array(s)
    step = np.sign(np.diff(a))
    decided = np.where(step != 0, np.arange(n - 1), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = np.append(step, 1)[decided] > 0  # S type: smaller than the suffix that follows
    smaller = np.append(smaller, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(a, minlength=symbols)
    ends = np.cumsum(counts)
    heads = (ends - counts).tolist()
    ends = ends.tolist()
    # The symbol before each suffix if that suffix is of the type a pass induces, else -1; empty places point to n.
    before = a[:-1]
    larger_before = np.concatenate([[-1], np.where(smaller[:-1], -1, before), [-1]]).tolist()
    smaller_before = np.concatenate([[-1], np.where(smaller[:-1], before, -1), [-1]]).tolist()

    def induce(order: list[int], s=s, larger=larger_before, smaller=smaller_before) -> list[int]:
        out, place = [n] * n, ends.copy()
        for i in reversed(order):
            c = s[i]
            at = place[c] = place[c] - 1
            out[at] = i
        place = heads.copy()
        for i in out:  # grows while it is read
            c = larger[i]
            if c >= 0:
                at = place[c]
                out[at] = i - 1
                place[c] = at + 1
        place = ends.copy()
        for i in reversed(out):  # and here too
            c = smaller[i]
            if c >= 0:
                at = place[c] = place[c] - 1
                out[at] = i - 1
        return out

    starts = lms.tolist()
    following = dict(zip(starts, starts[1:] + [n - 1], strict=True))
    is_start = np.zeros(n + 1, bool)
    is_start[lms] = True
    rough = np.array(induce(starts))
    rough = rough[is_start[rough]].tolist()
    names, name, last = {}, -1, None
    for i in rough:
        piece = s[i : following[i] + 1]
        if piece != last:
            name, last = name + 1, piece
        names[i] = name
    if name + 1 < len(starts):
        inner = suffix_array([names[i] for i in starts], name + 1)
        rough = [starts[i] for i in inner]
    return induce(rough)


def permuted_prefixes(s: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """(before, shared): for every suffix in text order the one before it in the array and the length of what
    both begin with. Going one step right in the text shortens that by one at most."""
    n = len(s)
    array, ahead = np.array(order), np.zeros(n, np.int64)
    ahead[array[1:]] = array[:-1]
    before = ahead.tolist()
    shared, length, none = [0] * n, 0, order[0]
    for i in range(n):
        if i == none:
            length = 0
            continue
        j = before[i]
        while s[i + length] == s[j + length]:
            length += 1
        shared[i] = length
        if length:
            length -= 1
    return before, shared


def repeated_windows(segments: list[bytes], width: int, unit: int = 1) -> list[np.ndarray]:
    """Per segment, a mask over its window starts: whether the window starts anywhere else in the segments."""
    count, kinds = len(segments), 256
    held = np.frombuffer(b"".join(segments), _TYPES[unit])
    if unit > 1:
        met, held = np.unique(held, return_inverse=True)
        kinds = len(met)
    held = (held.astype(np.int64) + count + 1).tolist()
    s: list[int] = []
    starts, at = [], 0
    for k, seg in enumerate(segments):
        starts.append(len(s))
        s.extend(held[at : at + len(seg) // unit])
        s.append(k + 1)
        at += len(seg) // unit
    s.append(0)
    before, shared = permuted_prefixes(s, suffix_array(s, count + kinds + 1))
    hit = np.flatnonzero(np.array(shared) >= width)
    mark = np.zeros(len(s), bool)
    mark[hit] = True
    mark[np.array(before)[hit]] = True
    return [mark[a : a + len(seg) // unit - width + 1] for a, seg in zip(starts, segments, strict=True)]


def repeated_by_gram(held: list[tuple[int, bytes, bytes]], width: int, unit: int = 1) -> Iterator[tuple[bytes, np.ndarray]]:
    """(seg, mask) of rows (gram, seg, bytes) sorted by gram: each gram's windows are sorted by themselves."""
    for _, rows in groupby(held, key=itemgetter(0)):
        _, segs, raw = zip(*rows, strict=True)
        yield from zip(segs, repeated_windows(list(raw), width, unit), strict=True)


def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every stretch of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


RANGES = "seg binary, ranges array<struct<lo:int,hi:int>>"


def _partnered(found: DataFrame, width: int, gram: int, cores: int, unit: int) -> DataFrame:
    """(seg) of the segments that share a core with another one."""
    places = core_places(width, gram, cores)

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seg, at, raw in zip(frame["seg"], frame["pick"], frame["bytes"], strict=True):
                for i, (before, after) in enumerate(places):
                    a, b = (at - before) * unit, (at + gram + after) * unit
                    if a >= 0 and b <= len(raw):
                        out.append((seg, hashlib.blake2b(raw[a:b], digest_size=16, salt=i.to_bytes(2, "big")).digest()))
            if out:
                yield pd.DataFrame(out, columns=["seg", "core"])

    made = freeze(found.select("seg", "pick", "bytes").mapInPandas(keys, "seg binary, core binary"))
    shared = made.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    return made.join(shared, "core", "left_semi").select("seg").distinct()


def _shards(rows: DataFrame, width: int, shard_bytes: int, unit: int) -> DataFrame:
    """(seg, ranges) out of (gram, seg, bytes): a shard is a stretch of a partition sorted by gram."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, bytes]] = []
        now, size = None, 0

        def done():
            found = [(seg, ranges(m)) for seg, m in repeated_by_gram(held, width, unit)]
            return pd.DataFrame([(g, r) for g, r in found if r], columns=["seg", "ranges"])

        for frame in frames:
            for gram, seg, raw in frame.itertuples(index=False, name=None):
                if gram != now and size >= shard_bytes:
                    yield done()
                    held, size = [], 0
                now = gram
                held.append((gram, seg, raw))
                size += len(raw)
        if held:
            yield done()

    # By a hash of the key: a plain repartition after a join on the same key is optimized away, and the join may
    # then be turned into one that leaves the rows where they are.
    # The number of tasks is explicit: merged by their bytes, a few tasks would do all the sorting.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("gram", "seg", "bytes").repartition(tasks, F.xxhash64("gram")).sortWithinPartitions("gram")
    return laid.mapInPandas(run, RANGES)


def _counted(rows: DataFrame, width: int, unit: int) -> DataFrame:
    """(seg, ranges) by counting every window's hash."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seg, raw in zip(frame["seg"], frame["bytes"], strict=True):
                hashes = [hashlib.blake2b(raw[i * unit : (i + width) * unit], digest_size=16).digest() for i in range(len(raw) // unit - width + 1)]
                yield pd.DataFrame({"seg": [seg] * len(hashes), "at": range(len(hashes)), "window": hashes})

    found = freeze(rows.select("seg", "bytes").mapInPandas(windows, "seg binary, at int, window binary"))
    twice = freeze(found.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"))
    hits = found.join(twice, "window", "left_semi").groupBy("seg").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return hits.select("seg", F.transform("ats", lambda i: F.struct(i.alias("lo"), i.alias("hi"))).alias("ranges"))


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """One row per distinct text (text_key, text, copies), bucketed by text."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(F.md5(body).alias("text_key"), body.alias("text")).groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name, parts = f"texts_{uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.bucketBy(parts, "text_key").sortBy("text_key").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _cut_bytes(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(gram, seg, pick, bytes) of the wanted segments, which are ranges of bytes."""
    raw = F.substring(F.col("text").cast("binary"), (F.col("at") + 1).cast("int"), F.col("n") + (width - 1))
    return texts.select("text_key", "text").join(wanted, "text_key").select("gram", "seg", "pick", raw.alias("bytes"))


def _cut_out(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(gram, seg, pick, bytes) of the wanted segments, which are ranges of words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded = Words()
        for frame in frames:
            for text, asked in zip(frame["text"], frame["asked"], strict=True):
                raw = coded(text.encode("utf-8", "surrogatepass"))
                rows = [(x["gram"], x["seg"], x["pick"], raw[x["at"] * WORD_BYTES : (x["at"] + x["n"] + width - 1) * WORD_BYTES]) for x in asked]
                yield pd.DataFrame(rows, columns=["gram", "seg", "pick", "bytes"])

    asked = wanted.groupBy("text_key").agg(F.collect_list(F.struct("gram", "seg", "pick", F.col("at").cast("int").alias("at"), "n")).alias("asked"))
    return texts.join(asked, "text_key").select("text", "asked").mapInPandas(run, "gram long, seg binary, pick int, bytes binary")


def repeats(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, cores: int = CORES, shard_bytes: int = SHARD_BYTES, gram_bytes: int = GRAM_BYTES, unit: int = 1) -> DataFrame:
    """Per text with repeats the sorted ranges (text_key, spans) whose windows also start elsewhere, in bytes
    or, with a ``unit`` of ``WORD_BYTES``, in words."""
    if gram > width:
        raise ValueError("a gram cannot be longer than a window")
    words = unit == WORD_BYTES

    def joined(frame: pd.DataFrame) -> Iterator[tuple[int, int, list[bytes]]]:
        """Stretches of rows with their symbols."""
        at = 0
        while at < len(frame):
            until, size, raw = at, 0, []
            while until < len(frame) and size < 400_000:
                raw.append(coded(frame["text"].iat[until].encode("utf-8", "surrogatepass")))
                size += len(raw[-1])
                until += 1
            yield at, until, raw
            at = until

    coded = Words() if words else bytes

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(gram, copies) of every run: all that the first pass needs."""
        for frame in frames:
            for at, until, raw in joined(frame):
                owner, _, _, _, hashes, _ = runs_of(raw, width, gram, unit)
                if len(owner):
                    yield pd.DataFrame({"gram": hashes, "copies": frame["copies"].to_numpy()[at:until][owner]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, until, raw in joined(frame):
                owner, place, start, count, hashes, picks = runs_of(raw, width, gram, unit)
                data = b"".join(raw)
                segs = [hashlib.blake2b(data[s * unit : (s + c + width - 1) * unit], digest_size=16).digest() for s, c in zip(start.tolist(), count.tolist(), strict=True)]
                rows = frame.iloc[at:until].iloc[owner]
                if len(rows):
                    yield pd.DataFrame({"text_key": rows["text_key"].to_numpy(), "copies": rows["copies"].to_numpy(), "at": place, "n": count, "gram": hashes, "pick": picks, "seg": segs})

    long_ones = texts.where(F.octet_length("text") >= (2 * width - 1 if words else width))
    runs = long_ones.select("text_key", "text", "copies").mapInPandas(run, "text_key string, copies long, at long, n int, gram long, pick int, seg binary")
    # The runs are cheap to find and many: they are found twice rather than stored.
    first = long_ones.select("text", "copies").mapInPandas(counted, "gram long, copies long")
    # Grams are stored before they are joined to: right above an aggregate a join cannot split a hot one.
    twice = freeze(first.groupBy("gram").agg(F.sum("copies").alias("met")).where("met > 1").select("gram"))
    met = freeze(runs.join(twice, "gram"))
    classes = freeze(
        met.groupBy("gram", "seg").agg(F.sum("copies").alias("met"), F.min(F.struct("text_key", "at")).alias("first"), F.min("n").alias("n"), F.min("pick").alias("pick"))
    )
    grams = freeze(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    wanted = freeze(classes.join(grams, "gram").select("gram", "seg", "n", "pick", "first.text_key", "first.at"))
    if words:
        found = freeze(_cut_out(texts.select("text_key", "text"), wanted, width))
        left = freeze(found.join(_partnered(found, width, gram, cores, unit), "seg", "left_semi"))
    else:
        # Bytes are cheap to cut out: this is done twice, and only those of segments with partners are stored.
        partnered = _partnered(_cut_bytes(texts, wanted, width), width, gram, cores, unit)
        left = freeze(_cut_bytes(texts, wanted.join(partnered, "seg", "left_semi"), width))
    sizes = left.groupBy("gram").agg(F.sum(F.length("bytes")).alias("held"))
    found = left.join(sizes.hint("merge"), "gram")
    shared = _shards(found.where(F.col("held") <= gram_bytes), width, shard_bytes, unit)
    hot = found.where(F.col("held") > gram_bytes)
    if not hot.isEmpty():
        shared = shared.union(_counted(hot, width, unit))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi")))
    known = classes.where("met > 1").select("seg", whole.alias("ranges"))
    hits = freeze(known.union(shared.join(known.select("seg"), "seg", "left_anti")))
    placed = met.select("text_key", "at", "seg").join(hits, "seg").select("text_key", "at", F.explode("ranges").alias("r"))
    span = F.struct((F.col("at") + F.col("r.lo")).alias("start"), (F.col("at") + F.col("r.hi") + width).alias("end"))
    return placed.groupBy("text_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


CUT = "text_key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, out: str = "repeats", with_text: bool = False, words: int | None = None, **options) -> DataFrame:
    """Add the struct ``out`` to every row: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs), the digest of
    the remaining bytes and, with ``with_text``, these as ``kept``. Characters that a cut leaves incomplete are
    left out of ``kept``, not of the digest. With ``words``, runs of so many words that occur twice go as well,
    however few bytes they have and whatever white space parts them."""
    texts = distinct_texts(docs, text)
    spans = repeats(texts, width, **options)
    if words is None:
        found = texts.join(spans, "text_key", "left").withColumn("word_spans", F.lit(None).cast(spans.schema["spans"].dataType))
    else:
        runs = repeats(texts, words, min(words, WORD_GRAM), **{k: v for k, v in options.items() if k != "gram"}, unit=WORD_BYTES)
        found = texts.join(spans, "text_key", "left").join(runs.withColumnRenamed("spans", "word_spans"), "text_key", "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, t, copies, found, by_words in frame.itertuples(index=False, name=None):
                raw = t.encode("utf-8", "surrogatepass")
                if copies > 1 and len(raw) >= width:
                    merged = [(0, len(raw))]
                else:
                    merged = []
                    both = [(s["start"], s["end"]) for s in found] if found is not None else []
                    if by_words is not None:
                        both = sorted(both + word_bytes(raw, [(s["start"], s["end"]) for s in by_words]))
                    for start, end in both:
                        if merged and start <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
                        else:
                            merged.append((start, end))
                at, kept = 0, []
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((key, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            yield pd.DataFrame(rows, columns=["text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = found.select("text_key", "text", "copies", "spans", "word_spans").mapInPandas(cut, CUT)
    fields = F.struct("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").alias(out)
    named = done.select(F.col("text_key").alias("_text_key"), fields)
    keyed = docs.withColumn("_text_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(named, "_text_key").drop("_text_key")
