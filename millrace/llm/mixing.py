"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share by weight of all words, at most ``most`` times what it
has; the excess goes to the sources below that, by weight again, until none is above. A target is so many whole
copies of all documents of the source (certain) and a rest, which a sample without repeats fills: documents
are ranked by random odds u / (1 - u), divided by their inclusion odds, and taken from the least up. The
inclusion odds of a document are those of its source, rest / (words - rest), times its ``prefer``. The size
of the sample is fixed in words: the document that the rest ends in is taken in part, so a source misses
its target by rounding only.

Random numbers come from a hash of seed and key, so reruns and other partitionings agree; rows of equal key
have equal numbers and are ranked by size. Sources are a table like any other: their targets come from
running sums over (most words per weight), their ranks and the documents' from range partitions, in which a
source with a third of all rows spreads over a third of the tasks. Only narrow rows are moved.

Null texts have no words, nothing is taken of texts without words, a null source comes last, null keys are hashed as
``null``. Very long texts are read whole. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.order import join_totals, lay_out, running_sum, running_sums, with_index

WEIGHTS, MOST = (1, 2, 3), 3
_HEX_DIGITS = 13  # 52 bits of a hash, which a double holds


def _is_white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


WHITE = _is_white()


def count_words(texts: pa.Array) -> np.ndarray:
    """Runs of other than white characters in every text; nulls have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    chars = np.frombuffer(memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b"", np.uint8)
    starts = offsets - offsets[0]
    inside = ~WHITE[chars]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = starts[:-1][starts[:-1] < len(chars)]
    new[first] = inside[first]
    return np.diff(np.searchsorted(np.flatnonzero(new), starts))


def with_size(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """The columns, and the number of words as ``size``."""
    narrow = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    fields = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(count_words(batch.column(batch.num_columns - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*(f.name for f in fields), "size"])

    return narrow.mapInArrow(count, f"{schema}, size long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    By their most words per weight, the sources that stop there come first: one stops if the even level of what the
    ones before it leave, over the weights from it on, is above its own."""
    whole = "decimal(38,0)"
    table = F.array(*[F.lit(int(w)) for w in weights])
    ranked = with_index(sizes, [F.col("source").asc_nulls_last()], name="nth")
    ranked = ranked.select("source", "source_size", F.get(table, (F.col("nth") % len(weights)).cast("int")).cast("long").alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    laid = lay_out(ranked, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()])
    upto = running_sums(laid, {"caps": "cap", "weights": "weight"})
    total = sizes.agg(F.sum("source_size").alias("all_words"))
    every = ranked.agg(F.sum("weight").alias("all_weights"))
    upto = join_totals(join_totals(upto, total, []), every, [])
    left = F.col("all_words").cast(whole) - (F.col("caps") - F.col("cap"))
    weights_on = F.col("all_weights") - (F.col("weights") - F.col("weight"))
    stops = F.col("cap").cast("decimal(20,0)") * weights_on.cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * left.cast("decimal(20,0)")
    marked = upto.select("source", "source_size", "weight", "cap", "all_words", stops.alias("stops"))
    open_ = marked.agg(
        (F.max("all_words") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))), F.lit(0))).alias("open_words"),
        F.sum(F.when(~F.col("stops"), F.col("weight"))).alias("open_weights"),
    )
    share = (F.col("weight").cast(whole) * F.col("open_words")).cast("double") / F.col("open_weights").cast("double")
    return join_totals(marked, open_, []).select(
        "source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def uniform(key: Column, seed: int = 0) -> Column:
    """A number inside (0, 1) from a hash of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 4 * _HEX_DIGITS)


def mix(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    prefer: Column | None = None,
    seed: int = 0,
    out: str = "mix",
) -> DataFrame:
    """The key and a struct ``out`` of every document: its size and its source's, the source's target,
    ``copies`` (whole ones), ``cut`` (words of one more copy, of which the mix takes only so many) and ``taken``
    (words of all of them).

    ``prefer`` may use ``size``; documents of a preference of 0 or null come into the sample last."""
    if key == out:
        raise ValueError("the key cannot be called like the result")
    sized = freeze(with_size(docs, text, F.col(key).alias("key"), F.col(source).alias("source")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(freeze(sizes), weights, most)
    words = F.floor(F.col("target") + 0.5)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0))
    goals = freeze(goals.withColumn("rest", words - F.col("whole") * F.col("source_size")))

    each = join_totals(sized, goals, ["source"])
    preference = F.lit(1.0) if prefer is None else prefer.cast("double")
    odds = F.col("rest") / (F.col("source_size") - F.col("rest")) * preference
    u = uniform(F.col("key"), seed)
    drawn = each.withColumn("draw", F.when((F.col("rest") > 0) & (F.col("size") > 0) & (preference > 0), u / (1 - u) / odds))
    laid = lay_out(drawn, [F.col("draw").asc_nulls_last(), F.col("key").asc_nulls_last(), F.col("size")], ["source"])
    upto = running_sum(laid, "size", "upto", ["source"])
    sample = F.least(F.greatest(F.col("rest") - (F.col("upto") - F.col("size")), F.lit(0)), F.col("size"))
    full = (sample == F.col("size")) & (F.col("size") > 0)
    result = F.struct(
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.when(full, 1).otherwise(0)).cast("int").alias("copies"),
        F.when(full, 0).otherwise(sample).cast("long").alias("cut"),
        (F.col("whole") * F.col("size") + sample).cast("long").alias("taken"),
    )
    return upto.select(F.col("key").alias(key), result.alias(out))
