"""A stored inverted index: texts are tokenized once, and searches read the blocks of their terms that can still count.

The index is a snapshot folder with three member tables:

* ``counts`` (key, most, words): what was read off the texts, a row per text, also for those without terms;
* ``terms`` (term, df, idf, bucket);
* ``postings`` (term, block, top, n, keys, weights): the texts of a block that hold a term, with the largest weight and their number. A
  weight is the count over the largest count of the text and the length of its TF-IDF vector; a search multiplies by the
  idf. They lie in folders by ``bucket``, a hash of the term, sorted by (term, block), so that a search opens the
  folders of its terms and skips row groups.

Texts whose heaviest term is the same share a block (a hash of that term), which sets the blocks' largest
weights apart. A search bounds every block by the sum of its terms' largest weights, scores the most promising
blocks, and then only the others whose bound reaches the last rank found so far; so it is exact, ties included.

Weights depend on the whole corpus (its size and each term's number of texts), so a load weighs all
stored counts anew, without reading earlier texts. Texts are moved with their words in arrays and inverted a block, or a piece of
one, at a time, so that no shuffle has a row per word but that of rare terms. A load that fails leaves the index as it
was. A text without terms matches nothing; null texts are such; null keys are one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import stored
from millrace.operators.text import asked_weights, by_term, term_lists, with_idf
from millrace.sources import snapshots

BUCKETS, BLOCKS = 64, 1024
COUNTS, TERMS, POSTINGS = "counts", "terms", "postings"
#: How an index lies in its folder; others are refused.
LAYOUT = "2"
#: Words of texts that are inverted at a time, and postings of one bucket that one task sorts.
PIECE_WORDS, PIECE_ROWS = 2_000_000, 2_000_000
#: What rounding to ``DIGITS`` can hide: a block within this of the last rank can still tie with it.
DIGITS = 6
_SLACK = 10.0**-DIGITS


def _without(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone.select(F.col("key").alias("gone")).distinct(), F.col("key").eqNullSafe(F.col("gone")), "left_anti")


def _weighed(counts: DataFrame) -> dict[str, DataFrame]:
    """terms and postings of all counts."""
    words = counts.select("key", "most", F.explode("words").alias("w")).select("key", "most", "w.term", "w.count")
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = with_idf(frequency, counts.select(F.count(F.lit(1))).scalar()).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    terms = stored(terms)
    raw = by_term(words, terms.select("term", "idf"), terms).withColumn("raw", F.col("count") / F.col("most") * F.col("idf"))
    # The heaviest term's block in one number, with its weight before it: a maximum of numbers needs no sort.
    heaviest = F.floor(F.col("raw") * F.lit(2.0**20)) * BLOCKS + F.pmod(F.xxhash64("term"), F.lit(BLOCKS))
    lengths = stored(raw.groupBy(F.col("key").alias("of")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"), F.max(heaviest).alias("heaviest"), F.count(F.lit(1)).alias("n")))
    lengths = lengths.withColumn("block", F.pmod("heaviest", F.lit(BLOCKS)).cast("int"))
    pieces = lengths.groupBy("block").agg(F.ceil(F.sum("n") / PIECE_WORDS).alias("pieces"))  # ``BLOCKS`` rows
    placed = counts.join(lengths.join(F.broadcast(stored(pieces)), "block"), F.col("key").eqNullSafe(F.col("of")))
    dealt = F.xxhash64("block", F.pmod(F.xxhash64("key"), F.col("pieces")))
    laid = placed.select("block", "key", (F.col("most") * F.col("length")).alias("over"), "words").repartition(dealt).sortWithinPartitions("block")
    kind = dict(counts.dtypes)["key"]
    inverted = laid.mapInArrow(_inverted, f"block int, term string, top double, n long, keys array<{kind}>, weights array<double>")
    bucketed = inverted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    # A bucket has no more rows than its terms have postings, nor than they have pieces of blocks.
    tall = terms.groupBy("bucket").agg(F.sum(F.least("df", pieces.select(F.sum("pieces")).scalar())).alias("rows")).select(F.max("rows")).scalar()
    spread = F.pmod(F.xxhash64("block", "term"), F.greatest(F.lit(1), F.ceil(tall / PIECE_ROWS)))
    postings = bucketed.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "block")
    return {TERMS: terms, POSTINGS: postings.select("bucket", "term", "block", "top", "n", "keys", "weights")}


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, term, top, n, keys, weights) out of rows (block, key, over, words) sorted by block."""
    for batch in batches:
        lists = batch.column("words")
        upto = lists.offsets.to_numpy()
        at = 0
        while at < len(batch):
            until = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE_WORDS, side="right")) - 1)
            words = lists.values.slice(upto[at], upto[until] - upto[at])
            owner = np.repeat(np.arange(at, until), np.diff(upto[at : until + 1]))
            weight = words.field("count").to_numpy() / batch.column("over").to_numpy()[owner]
            coded = words.field("term").dictionary_encode()
            code, block = coded.indices.to_numpy(), batch.column("block").to_numpy()[owner].astype(np.int64)
            both = block * len(coded.dictionary) + code
            order = np.argsort(both, kind="stable")
            both, weight = both[order], weight[order]
            begins = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            upon = pa.array(np.append(begins, len(both)), pa.int32())
            first = order[begins]
            columns = [
                pa.array(block[first], pa.int32()),
                coded.dictionary.take(pa.array(code[first])),
                pa.array(np.maximum.reduceat(weight, begins)),
                pa.array(np.diff(np.append(begins, len(both))), pa.int64()),
                pa.ListArray.from_arrays(upon, batch.column("key").take(pa.array(owner[order]))),
                pa.ListArray.from_arrays(upon, pa.array(weight)),
            ]
            done = pa.RecordBatch.from_arrays(columns, names=["block", "term", "top", "n", "keys", "weights"])
            for start in range(0, len(done), 100_000):
                yield done.slice(start, 100_000)
            at = until


def add(docs: DataFrame, key: str, text: str, folder: str, job: str | None = None, inputs: tuple[str, ...] = ()) -> snapshots.Snapshot:
    """Index texts, replacing those of the same key; the first load makes the index. Of several rows of a key in one
    load, the terms count together."""
    spark = docs.sparkSession
    base = _opened(spark, folder)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    new = snapshots.write_part(folder, COUNTS, term_lists(rows, "key", "text"))
    return _publish(spark, folder, base, [new], snapshots.read_parts(spark, folder, [new]).select("key"), "append", job, inputs)


def remove(keys: DataFrame, key: str, folder: str, job: str | None = None) -> snapshots.Snapshot:
    """Take texts out of the index."""
    spark = keys.sparkSession
    base = _opened(spark, folder)
    if base is None:
        raise ValueError(f"no index in {folder}")
    gone = keys.select(F.col(key).alias("key"))
    return _publish(spark, folder, base, [], gone, "remove", job, ())


def _publish(spark: SparkSession, folder: str, base: snapshots.Snapshot | None, new: list[snapshots.Part], gone: DataFrame, mode: str, job: str | None, inputs: tuple[str, ...]) -> snapshots.Snapshot:
    every, kept = snapshots.read_parts(spark, folder, new) if new else None, ()
    if base is not None:
        old = snapshots.read_member(spark, folder, base, COUNTS)
        replaces = not old.select("key").join(gone.select(F.col("key").alias("gone")), F.col("key").eqNullSafe(F.col("gone")), "left_semi").isEmpty()
        if replaces or mode == "remove":
            new = [snapshots.write_part(folder, COUNTS, _without(old, gone)), *new]
            every = snapshots.read_parts(spark, folder, new)
        else:
            every, kept = old.unionByName(every), (COUNTS,)
    weighed = _weighed(every)
    facts = {"buckets": str(BUCKETS), "blocks": str(BLOCKS), "layout": LAYOUT}
    return snapshots.publish(spark, folder, base, {COUNTS: new, **weighed}, kept, mode, job, inputs, facts=facts, partition_by={POSTINGS: ["bucket"]})


def _opened(spark: SparkSession, folder: str, version: int | None = None) -> snapshots.Snapshot | None:
    snapshot = snapshots.open_snapshot(spark, folder, version)
    if snapshot is not None and snapshot.facts.get("layout") != LAYOUT:
        raise ValueError(f"the index in {folder} has another layout; load its texts into a new folder")
    return snapshot


class Index:
    """One version of a stored index, by default the latest."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        snapshot = _opened(spark, folder, version)
        if snapshot is None:
            raise ValueError(f"no index in {folder}")
        self.terms, self.postings, self.counts = (snapshots.read_member(spark, folder, snapshot, name) for name in (TERMS, POSTINGS, COUNTS))

    def _found(self, asked: dict[str, float]) -> tuple[DataFrame, Column]:
        """The postings of the question's terms, and what to multiply their weights by."""
        known = self.terms.where(F.col("term").isin(list(asked))).select("term", "bucket", "idf").collect()  # words of one question
        read = self.postings.where(F.col("bucket").isin(sorted({r.bucket for r in known})) & F.col("term").isin(list(asked)))
        return read, _lookup({r.term: asked[r.term] * r.idf for r in known})

    def _bounds(self, asked: dict[str, float]) -> list[tuple[int, float, int]]:
        """(block, the most that a text in it can score, postings), best first: at most ``BLOCKS`` rows."""
        read, weight = self._found(asked)
        # A block may lie in several pieces, of which each has its own largest weight.
        tops = read.groupBy("term", "block").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
        found = tops.groupBy("block").agg(F.sum(F.col("top") * weight).alias("bound"), F.sum("n").alias("n"))
        return sorted(((r.block, r.bound, r.n) for r in found.collect()), key=lambda b: (-b[1], b[0]))

    def _scores(self, asked: dict[str, float], blocks: list[int]) -> DataFrame:
        read, weight = self._found(asked)
        pairs = read.where(F.col("block").isin(blocks)).select("term", F.explode(F.arrays_zip("keys", "weights")).alias("p"))
        scored = pairs.groupBy(F.col("p.keys").alias("key")).agg(F.round(F.sum(F.col("p.weights") * weight), DIGITS).alias("score"))
        return scored.where("score > 0").orderBy(F.desc("score"), "key")

    def plan(self, question: str, limit: int | None) -> tuple[dict[str, float], list[int], list[int]]:
        """The question's weights, the blocks that must be read for its first ``limit`` texts, and those passed over."""
        asked = asked_weights(self.terms, question)
        bounds = self._bounds(asked) if asked else []
        if limit is None:
            return asked, [b for b, _, _ in bounds], []
        first, postings = 0, 0
        while first < len(bounds) and postings < 4 * limit * len(asked):
            postings += bounds[first][2]
            first += 1
        blocks = [b for b, _, _ in bounds[:first]]
        if first < len(bounds):
            reached = self._scores(asked, blocks).limit(limit).agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n")).first()
            needed = reached.last - _SLACK if reached.n == limit else 0.0
            blocks += [b for b, bound, _ in bounds[first:] if bound >= needed]
        return asked, blocks, [b for b, _, _ in bounds[len(blocks) :]]

    def search(self, question: str, limit: int | None = 10) -> DataFrame:
        """(key, score) of the texts that share a term with the question by TF-IDF cosine, ``limit`` of them or all."""
        asked, blocks, _ = self.plan(question, limit)
        if not blocks:
            return self.counts.select("key", F.lit(0.0).alias("score")).where("false")
        found = self._scores(asked, blocks)
        return found if limit is None else found.limit(limit)


def _lookup(asked: dict[str, float]) -> Column:
    """The weight of ``term`` in the question: a table of its words."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in asked.items() for x in item]), F.col("term"))
