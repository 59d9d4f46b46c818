"""Near duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class from the
   start, so copies cost no more than one row each.
2. Every class has one signature of ``trees`` * ``depth`` values, and each tree an order of its own: the signature
   turned so that it begins with the tree's values. A tree's order is sorted by ranges, whatever their keys, so a
   crowded prefix is spread over tasks. Neighbours in an order are linked with the length of their common prefix,
   if that is ``depth`` or more; ranges hand their first and last rows on, so no neighbours are missed.
   Components over these links hold every pair that shares a region (a prefix of ``depth`` values) in some tree.
3. Inside a component, one class after another is compared with all others on the full sets, by one vector
   operation each, until the classes not yet compared are all linked to each other; so a group of thousands of
   copies takes a few comparisons, and a group of strangers takes them all. No pair is left out.
4. A component too large for one task is crowded: only links of longer common prefixes hold it together now, and
   longer ones yet where it stays crowded, so each of its parts is as deep as it needs. A part that no prefix
   divides (copies by the thousands) is dealt by hash. Parts are confirmed, then one class of each linked group
   against the others.
5. What depth has parted is made good exactly: each region that still holds classes of several parts, not linked
   to each other, is compared as a whole. Only a single region too large for a task is compared piece by piece.
   Classes that share no region are never compared, even if a chain of regions leads from one to the other.

No table on the way has a bound but by the corpus (the ends of ranges excepted), so joins ask not to be broadcast.

Two texts of a similarity s share no region with the chance (1 - s^depth)^trees: 2e-8 at 0.85. Values are cut to
16 bits, which can only add candidates.

A word is a run of anything but ASCII white space, with A-Z lower-cased. With fewer words than a shingle the
whole sequence is the one shingle; null texts and texts without words have an empty set and link with nothing.
Texts are read whole, whatever their length; the largest set is held by one task. An empty table gives no rows.
Columns beside key and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.names import fresh
from millrace.llm.stored import stored

TREES, DEPTH = 24, 4
#: How many values of a tree's order are looked at, in multiples of ``depth``.
REACH = 3
#: Shingles whose sets one task may hold at a time.
TASK_SHINGLES = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, n: int, words: Words) -> np.ndarray:
    """The sorted, distinct hashes of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in tokens], dtype=np.uint64)
    width = min(n, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        s = _mixed(s * _MIX + h[k : len(h) - width + 1 + k])
    return np.unique(s)


def _seeds(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash values, a row per set; the sets must not be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), count), np.uint64)
    for j, seed in enumerate(_seeds(count)):
        out[:, j] = np.minimum.reduceat(flat * seed, starts)
    return out


FEATURES = "doc_id {}, text_key binary, n_shingles long, class binary, signature binary"


def features(docs: DataFrame, key: str, text: str, n: int, trees: int, depth: int) -> DataFrame:
    """Per row: a key of its text, the size and the key of its set, and its signature, tree after tree, two bytes
    a value. Rows without words have no class and no signature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            at = 0
            while at < len(frame):
                until, size = at, 0
                while until < len(frame) and size < 1_000_000:
                    size += len(frame["text"].iat[until] or "") + 100
                    until += 1
                part, at = frame.iloc[at:until], until
                sets = [shingles(t, n, words) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                signature = [None] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full], trees * depth)
                    for i, row in zip(full, (_mixed(values) >> np.uint64(48)).astype(">u2"), strict=True):
                        signature[i] = row.tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "text_key": part["text_key"],
                        "n_shingles": [len(s) for s in sets],
                        "class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "signature": signature,
                    }
                )

    kind = dict(docs.dtypes)[key]
    # A column of whole numbers with nulls would come as doubles: it goes as text and is cast back.
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, FEATURES.format("string")).withColumn("doc_id", F.col("doc_id").cast(kind))


def _orders(classes: DataFrame, trees: int, depth: int, values: int) -> DataFrame:
    """(class, key) per tree: the tree's number and the first ``values`` values of its order."""
    turned = F.expr(f"transform(sequence(0, {trees - 1}), t -> concat(unhex(lpad(hex(t), 4, '0')), substring(concat(signature, signature), t * {2 * depth} + 1, {2 * values})))")
    return classes.select("class", F.explode(turned).alias("key"))


def neighbours(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(a, b, level): classes next to each other in a tree's order that share at least ``depth`` values, and how
    many they share in the tree where they share most. One sort; ranges hand on their first and last rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            if frame.empty:
                continue
            if last is None:
                yield frame.iloc[:1].rename(columns={"class": "a"}).assign(b=None, level=None)[["a", "b", "level", "key"]]
            else:
                frame = pd.concat([last, frame])
            values = np.frombuffer(b"".join(frame["key"]), ">u2").reshape(len(frame), -1)
            level = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1) - 1  # the first value is the tree
            near, names = np.flatnonzero(level >= depth), frame["class"].to_numpy()
            yield pd.DataFrame({"a": names[near], "b": names[near + 1], "level": level[near], "key": None})
            last = frame.iloc[-1:]
        if last is not None:
            yield last.rename(columns={"class": "a"}).assign(b=None, level=None)[["a", "b", "level", "key"]]

    laid = _orders(classes, trees, depth, min(REACH, trees) * depth).repartitionByRange("key", "class").sortWithinPartitions("key", "class")
    told = stored(laid.mapInPandas(run, "a binary, b binary, level int, key binary"))
    # Two rows per range, so one window holds them all.
    ends = told.where("b IS NULL").select("a", "key", F.lead("a").over(Window.orderBy("key", "a")).alias("b"), F.lead("key").over(Window.orderBy("key", "a")).alias("next"))
    steps = [F.when(F.substring("key", 1, 2 + 2 * d) == F.substring("next", 1, 2 + 2 * d), d).otherwise(0) for d in range(depth, min(REACH, trees) * depth + 1)]
    ends = ends.select("a", "b", F.greatest(*steps, F.lit(0)).alias("level")).where(F.col("level") >= depth)
    links = told.where("b IS NOT NULL").select("a", "b", "level").union(ends).where("a <> b")
    return stored(links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("level").alias("level")))


def confirm(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * intersection >= percent * union that join all that such links can join.

    ``groups`` says which sets are known to be linked. One set after another is compared with all others by
    counting, until all sets not yet compared are in one group."""
    count, links = len(sets), []
    sizes = np.array([len(s) for s in sets])
    group = np.unique(np.array(groups), return_inverse=True)[1]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1]]))
    mark = np.zeros(ids.max() + 1, np.int64)
    waiting = np.ones(count, bool)
    while True:
        rest = np.flatnonzero(waiting)
        members = np.bincount(group[rest])
        if np.count_nonzero(members) < 2:
            return links
        # The first of the largest group joins most; afterwards small groups are soonest done.
        want = members.argmax() if len(rest) == count else np.where(members > 0, members, count + 1).argmin()
        i = rest[np.flatnonzero(group[rest] == want)[0]]
        waiting[i] = False
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        near = 100 * shared >= percent * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(near & (group != group[i])):
            if group[j] != group[i]:
                links.append((int(i), int(j)))
                group[group == group[j]] = group[i]


def _confirm_groups(rows: DataFrame, group: str, n: int, percent: int) -> DataFrame:
    """(a, b) links inside each group of rows (class, known, text); a group is one piece of a sorted partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        now, classes, known, sets = None, [], [], []

        def done():
            pairs = confirm(sets, known, percent) if len(sets) > 1 else []
            return pd.DataFrame([(classes[i], classes[j]) for i, j in pairs], columns=["a", "b"])

        for frame in frames:
            for g, c, k, t in frame.itertuples(index=False, name=None):
                if g != now:
                    if len(sets) > 1:
                        yield done()
                    now, classes, known, sets = g, [], [], []
                classes.append(c)
                known.append(k)
                sets.append(shingles(t, n, words))
        if len(sets) > 1:
            yield done()

    # By a hash of the key: a plain repartition after a join on the same key is optimized away, and the join may
    # then be turned into one that leaves the rows where they are.
    laid = rows.select(group, "class", "known", "text").repartition(F.xxhash64(group)).sortWithinPartitions(group, "class")
    return laid.mapInPandas(run, "a binary, b binary")


def _parts(rows: DataFrame, links: DataFrame, depths: list[int], limit: int) -> DataFrame:
    """(class, part): the rows (class, size) in parts of at most about ``limit`` shingles, held together by links
    of common prefixes as long as it takes; what the longest does not divide is dealt by hash."""
    waiting, done = rows, None
    for depth in depths:
        inner = links.where(F.col("level") >= depth).join(waiting.select(F.col("class").alias("a")).hint("merge"), "a", "left_semi")
        joined = stored(components(inner, "a", "b")).select(F.col("node").alias("class"), F.col("component").alias("part"))
        placed = stored(waiting.join(joined.hint("merge"), "class", "left").select("class", "size", F.coalesce("part", "class").alias("part")))
        held = stored(placed.groupBy("part").agg(F.sum("size").alias("held")))
        placed = stored(placed.join(held.hint("merge"), "part"))
        settled = placed.where(F.col("held") <= limit).select("class", F.xxhash64("part").alias("part"))
        done = settled if done is None else done.union(settled)
        waiting = placed.where(F.col("held") > limit).select("class", "size")
        if waiting.isEmpty():
            return stored(done)
    dealt = F.xxhash64("part", F.pmod(F.xxhash64("class"), F.ceil(2 * F.col("held") / F.lit(limit)).cast("long")))
    return stored(done.union(placed.where(F.col("held") > limit).select("class", dealt.alias("part"))))


def _confirm_large(members: DataFrame, links: DataFrame, n: int, percent: int, trees: int, depth: int, limit: int) -> DataFrame:
    """Links inside components too large for one task. members: component, total, class, size, signature, text."""
    parts = _parts(stored(members.select("class", "size")), links, [depth + 1, depth + 2, *range(2 * depth, min(REACH, trees) * depth + 1, depth)], limit // 2)
    placed = stored(members.join(parts.hint("merge"), "class"))
    inside = stored(_confirm_groups(placed.withColumn("known", F.xxhash64("class")), "part", n, percent))

    def labelled(found: DataFrame) -> DataFrame:
        named = stored(components(found, "a", "b")).select(F.col("node").alias("class"), F.col("component").alias("label"))
        return stored(placed.drop("text").join(named.hint("merge"), "class", "left").withColumn("label", F.coalesce("label", "class")))

    told = labelled(inside)
    texts = placed.select("class", "text")
    # The first classes of the groups, dealt over as many tasks as the whole component would need.
    dealt = F.xxhash64("component", F.pmod(F.xxhash64("class"), F.ceil(2 * F.col("total") / F.lit(limit)).cast("long")))
    first = told.where(F.col("class") == F.col("label")).select("class", dealt.alias("g"), F.xxhash64("class").alias("known"))
    between = stored(_confirm_groups(first.join(texts.hint("merge"), "class"), "g", n, percent))
    found = inside.union(between)

    # Regions that hold classes of several parts and several groups; equal ones of several trees count once.
    told = labelled(found)
    held = _orders(told, trees, depth, depth).join(told.select("class", "size", "part", "label").hint("merge"), "class")
    regions = held.groupBy("key").agg(
        F.sum("size").alias("held"),
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("class")).alias("same"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("same2"),
        *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("part", "label")],
    )
    open_ = regions.where("min_part <> max_part AND min_label <> max_label").groupBy("n", "same", "same2", "held").agg(F.min("key").alias("key"))
    rest = stored(held.join(open_.select("key", F.col("held").alias("region_size")).hint("merge"), "key").withColumn("known", F.xxhash64("label")))
    whole = rest.where(F.col("region_size") <= limit).select("key", "class", "known")
    found = found.union(stored(_confirm_groups(whole.join(texts.hint("merge"), "class"), "key", n, percent)))
    crowded = rest.where(F.col("region_size") > limit)
    if crowded.isEmpty():
        return found
    piece = F.pmod(F.xxhash64("part"), F.ceil(4 * F.col("region_size") / F.lit(limit)).cast("long"))
    crowded = stored(crowded.select("key", "class", "known", piece.alias("piece")))
    pieces = stored(crowded.groupBy("key", "piece").agg(F.min("known").alias("lo"), F.max("known").alias("hi")))
    other = pieces.select("key", F.col("piece").alias("piece2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = pieces.join(other.hint("merge"), "key").where("piece <= piece2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    pairs = pairs.select("key", F.xxhash64("key", "piece", "piece2").alias("g"), F.explode(F.array_distinct(F.array("piece", "piece2"))).alias("piece"))
    across = crowded.join(pairs.hint("merge"), ["key", "piece"]).select("g", "class", "known")
    return found.union(stored(_confirm_groups(across.join(texts.hint("merge"), "class"), "g", n, percent)))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, limit: int = TASK_SHINGLES
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id`` (the smallest key that links of
    100 * intersection >= ``percent`` * union of ``n``-word shingle sets can reach), ``kept`` (the row holds it) and ``text_md5``.

    Rows that repeat key and text are all kept or all not. A null key is larger than any other."""
    found = stored(features(docs, key, text, n, trees, depth))
    # One row speaks for a class, so that of many copies one text is moved.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    classes = stored(
        found.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("text_key", name.alias("name"))).alias("row"), F.min("n_shingles").alias("size"), F.min("signature").alias("signature"))
        .select("class", "doc_id", "row.*", "size", "signature")
    )
    near = neighbours(classes, trees, depth)
    candidate = stored(components(near, "a", "b")).select(F.col("node").alias("class"), "component")
    member = stored(candidate.join(classes.drop("doc_id").hint("merge"), "class"))
    totals = stored(member.groupBy("component").agg(F.sum("size").alias("total")))
    member = stored(member.join(totals.hint("merge"), "component"))
    own = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    texts = docs.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), own.alias("name"), F.col(text).alias("text"))
    texts = texts.join(member.select("text_key", "name").hint("merge"), ["text_key", "name"], "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    sets = stored(member.join(texts.hint("merge"), "text_key").select("component", "total", "class", "size", "signature", "text"))
    small = sets.where(F.col("total") <= limit).withColumn("known", F.xxhash64("class"))
    links = stored(_confirm_groups(small, "component", n, percent))
    large = sets.where(F.col("total") > limit)
    if not large.isEmpty():
        links = links.union(_confirm_large(large, near, n, percent, trees, depth, limit))
    joined = stored(components(links, "a", "b")).select(F.col("node").alias("class"), "component")
    known = joined.join(classes.select("class", "doc_id").hint("merge"), "class")
    least = stored(known.groupBy("component").agg(F.min("doc_id").alias("least")))
    named = classes.select("class", "doc_id").join(joined.join(least.hint("merge"), "component").select("class", "least").hint("merge"), "class", "left")
    named = stored(named.select("class", F.coalesce("least", "doc_id").alias("least")))
    out = found.join(named.hint("merge"), "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select(F.col("doc_id").alias(key), "n_shingles", "component_id", kept, F.lower(F.hex("text_key")).alias("text_md5"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold their component's smallest key. Of rows that repeat key and text one stays,
    any of them. All columns of ``docs`` come back, whatever their names."""
    name = fresh("row", docs)
    row = lambda of, digest: F.concat_ws(" ", F.coalesce(F.col(of).cast("string"), F.lit("null")), digest).alias(name)
    kept = near_duplicates(docs, key, text, **options).where("kept").select(row(key, F.col("text_md5")))
    named = docs.withColumn(name, row(key, F.md5(F.coalesce(text, F.lit("")))))
    return named.join(kept.hint("merge"), name, "left_semi").dropDuplicates([name]).drop(name)
