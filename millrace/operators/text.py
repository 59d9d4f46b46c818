"""Text embeddings, vector search, sentiment and keyword search. Whole texts are read, never prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.freeze import stored
from millrace.functions.order import leading

# The characters whose shares make up a character embedding.
EMBED_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 .,!?-"
WORD = r"[\p{L}\p{N}]+"
QUERY_BLOCK, CORPUS_BLOCK = 20_000, 20_000  # rows of either side that one task compares


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def with_unit(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Add the L2-normalized vector; a zero vector stays as it is. The length is computed once per row."""
    # transform with a one-element array binds the vector and its length, which a plain column would
    # recompute for every element.
    bound = F.expr(
        f"""transform(array(struct(`{vector}` AS v, sqrt(aggregate(`{vector}`, 0D, (t, x) -> t + x * x)) AS l)),
            p -> if(p.l = 0, p.v, transform(p.v, x -> x / p.l)))[0]"""
    )
    return df.withColumn(name, bound)


def embed_chars(df: DataFrame, text: str, dims: int = 64, name: str = "embedding") -> DataFrame:
    """Share of each of 42 characters in the lower-cased text, padded with 0 to ``dims``, L2-normalized."""
    characters = EMBED_CHARACTERS[:dims]

    @F.pandas_udf("array<double>")
    def shares(texts: pd.Series) -> pd.Series:
        # str.count scans at memory speed, which 42 replaced copies of the text in the JVM do not.
        padding = [0.0] * (dims - len(characters))
        return texts.map(lambda t: None if t is None else [t.count(c) / max(len(t), 1) for c in characters] + padding)

    return with_unit(df.withColumn("_raw", shares(F.lower(F.col(text)))), "_raw", name).drop("_raw")


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokenize(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tokens(F.col(text)))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, count, largest count of the text). A text without terms keeps one row without term.

    One shuffle, of the texts and not of their words. Words are counted where a key's texts arrive, a piece of many
    texts at a time; the texts of one key come one after another."""
    kind = dict(df.dtypes)[key]
    counted = _words_by_key(df, key, text).mapInArrow(_counted(_as_rows), f"key {kind}, term string, count long, most long")
    return counted.withColumnRenamed("key", key)


def term_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, largest count of the text, words as an array of term and count), a row per key, by the steps of ``term_counts``."""
    kind = dict(df.dtypes)[key]
    counted = _words_by_key(df, key, text).mapInArrow(_counted(_as_lists), f"key {kind}, most long, words array<struct<term:string,count:long>>")
    return counted.withColumnRenamed("key", key)


def _words_by_key(df: DataFrame, key: str, text: str) -> DataFrame:
    same = F.xxhash64(key, F.col(key).isNull())
    rows = df.select(key, text).repartition(key).select(F.col(key).alias("key"), same.alias("same"), tokens(F.col(text)).alias("words"))
    return rows.sortWithinPartitions("key")


#: Words that are counted at a time.
PIECE_WORDS = 500_000


def _counted(emit: Callable[..., pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the words of sorted rows (key, same, words). The rows of the last key wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            same = batch.column("same").to_numpy()
            last = len(same) - 1 - int(np.argmax(same[::-1] != same[-1])) + 1 if (same != same[-1]).any() else 0
            if held and (last or held[-1].column("same")[-1].as_py() != same[0]):
                yield from _counts_of(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks(), emit)
                held = []
            elif last:
                yield from _counts_of(pa.Table.from_batches([batch.slice(0, last)]).combine_chunks(), emit)
            held.append(batch.slice(last))
        if held:
            yield from _counts_of(pa.Table.from_batches(held).combine_chunks(), emit)

    return run


def _as_rows(keys: pa.ChunkedArray, owner: np.ndarray, term: pa.Array, count: np.ndarray, most: np.ndarray) -> pa.Table:
    """A row per text and term; one without term for a text without terms."""
    bare = np.flatnonzero(most == 0)
    columns = [
        keys.take(pa.array(np.concatenate([owner, bare]))).combine_chunks(),
        pa.concat_arrays([term, pa.nulls(len(bare), term.type)]),
        pa.array(np.concatenate([count, most[bare]]), pa.int64()),
        pa.array(np.concatenate([most[owner], most[bare]]), pa.int64()),
    ]
    return pa.table(columns, names=["key", "term", "count", "most"])


def _as_lists(keys: pa.ChunkedArray, owner: np.ndarray, term: pa.Array, count: np.ndarray, most: np.ndarray) -> pa.Table:
    """A row per text."""
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(most)))])
    words = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([term, pa.array(count, pa.int64())], names=["term", "count"]))
    return pa.table([keys.combine_chunks(), pa.array(most, pa.int64()), words], names=["key", "most", "words"])


def _counts_of(rows: pa.Table, emit: Callable[..., pa.Table]) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    same = rows.column("same").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))  # the first row of every key
    lists = rows.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    words = lists.flatten()
    ends = np.append(begins[1:], len(same))
    at = 0
    while at < len(begins):
        until = max(at + 1, int(np.searchsorted(upto[ends], upto[begins[at]] + PIECE_WORDS, side="right")))
        first, stop = begins[at], ends[until - 1]
        owner = np.repeat(np.repeat(np.arange(until - at), ends[at:until] - begins[at:until]), sizes[first:stop])
        coded = words.slice(upto[first], upto[stop] - upto[first]).dictionary_encode()
        code, count = np.unique(owner * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
        owner, code = np.divmod(code, max(len(coded.dictionary), 1))
        most = np.zeros(until - at, np.int64)
        np.maximum.at(most, owner, count)
        keys = rows.column("key").take(pa.array(begins[at:until]))
        yield from emit(keys, owner, coded.dictionary.take(pa.array(code)), count.astype(np.int64), most).combine_chunks().to_batches()
        at = until


#: Terms whose rows are broadcast at most; they hold most of a text's words.
OFTEN = 50_000


def often(frequency: DataFrame) -> DataFrame:
    """The terms of (term, df) with the largest df, at most ``OFTEN``; ties are all in or all out."""
    sizes = frequency.groupBy("df").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are different df
    least = sizes.withColumn("n", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df")))).where(F.col("n") <= OFTEN)
    return frequency.where(F.col("df") >= least.select(F.min("df")).scalar())


def by_term(counts: DataFrame, table: DataFrame, frequency: DataFrame, how: str = "inner") -> DataFrame:
    """``counts`` with the rows of ``table`` of their term. Rows of frequent terms, at most ``OFTEN``, are broadcast, so
    that only rare terms are shuffled and no term is hot."""
    terms = F.broadcast(stored(often(frequency).select("term")))
    common = counts.join(F.broadcast(stored(table.join(terms, "term", "right" if how == "left" else "inner"))), "term")
    return common.unionByName(counts.join(terms, "term", "left_anti").join(table, "term", how))


def tfidf_vocabulary(counts: DataFrame, documents: DataFrame, dims: int = 128, max_features: int = 1000) -> DataFrame:
    """The min(dims, max_features) terms in most texts (ties by term) with index and idf."""
    size = min(dims, max_features)
    total = documents.select(F.count(F.lit(1))).scalar()
    frequency = counts.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    top = frequency.orderBy(F.desc("df"), "term").limit(size).withColumn("n", total)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "term")) - 1  # ``size`` rows
    return top.select("term", place.alias("idx"), (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_rows(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Sparse L2-normalized vectors as (key, idx, weight); a text without known terms has one null row.

    The vocabulary has at most ``dims`` rows by construction; only its terms are shuffled."""
    raw = counts.join(F.broadcast(vocabulary), "term").withColumn("raw", F.col("count") / F.nullif("most", F.lit(0)) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    rows = raw.withColumn("length", length).select(key, "idx", (F.col("raw") / F.nullif("length", F.lit(0.0))).alias("weight"))
    known = rows.select(F.col(key).alias("_known")).distinct()
    bare = counts.select(key).distinct().join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    return rows.unionByName(bare.select(key, F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("weight")))


def embed_tfidf(df: DataFrame, key: str, text: str, dims: int = 128, max_features: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors and the vocabulary they are over."""
    counts = stored(term_counts(df, key, text))
    vocabulary = stored(tfidf_vocabulary(counts, df, dims, max_features))
    return tfidf_rows(counts, vocabulary, key), vocabulary


def dense(rows: DataFrame, key: str, dims: int, name: str = "embedding") -> DataFrame:
    """Dense vectors of ``dims`` entries out of sparse rows."""
    entries = F.map_from_entries(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "weight"))))
    grouped = rows.groupBy(key).agg(entries.alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return grouped.select(key, filled.alias(name))


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    scale = norm(a) * norm(b)
    return _same_length(a, b, F.when(scale == 0, 0.0).otherwise(dot / F.nullif(scale, F.lit(0.0))))


def euclidean(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return _same_length(a, b, F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, x: t + x)))


def _matching(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    for column, value in (filters or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def _units(vectors: pd.Series) -> np.ndarray:
    rows = vectors.tolist()
    width = len(rows[0]) if rows else 0
    if any(len(v) != width for v in rows):
        raise ValueError("vectors differ in length")
    x = np.concatenate([np.asarray(v, dtype=float) for v in rows]).reshape(len(rows), width) if rows else np.empty((0, 0))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows of ``x`` that have fewer than ``k`` equal rows before them: of more copies none is needed."""
    if not x.shape[1]:
        return np.arange(min(k, len(x)))
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[nth < k])


def _leading_of(owner: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Places in these arrays of the k best of every owner, ties to the smaller place, best first."""
    order = np.lexsort((place, -score, owner))
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < k]


class TopK:
    """The k best corpus rows of each of a block of queries, gathered block by block; exact, ties to smaller places.

    Products in single precision leave out what is surely below a query's k-th best so far; the others are scored in
    double precision. Nothing is sorted but the few rows that are left."""

    TILE, QUERIES, PIECE = 2_000, 512, 1 << 16

    def __init__(self, units: np.ndarray, k: int, least: np.ndarray | None = None):
        self.units, self.k = units, k
        self.slack = (units.shape[1] + 4) * 2.0**-23 + 1e-11
        self.floor = np.full(len(units), -np.inf) if least is None else np.where(np.isnan(least), -np.inf, least)
        self.best = np.full((len(units), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = 0  # rows scored in double precision

    def add(self, x: np.ndarray, places: np.ndarray, queries: np.ndarray) -> None:
        """Compare the queries (places in the block) with unit vectors whose places ascend."""
        if self.units.shape[1] != x.shape[1]:
            raise ValueError("vectors differ in length")
        kept = _first_copies(x, self.k)
        x, places = x[kept], places[kept]
        rough, finite = x.astype(np.float32), np.isfinite(x).all()
        for start in range(0, len(queries), self.QUERIES):
            asked = queries[start : start + self.QUERIES]
            q = self.units[asked].astype(np.float32)
            whole = finite and np.isfinite(q).all()
            for at in range(0, len(x), self.TILE):
                near = q @ rough[at : at + self.TILE].T
                self._tile(x[at : at + self.TILE], places[at : at + self.TILE], asked, near if whole else np.nan_to_num(near, nan=-2.0))

    def _tile(self, x: np.ndarray, places: np.ndarray, asked: np.ndarray, near: np.ndarray) -> None:
        floor = np.nextafter((self.floor[asked] - self.slack).astype(np.float32), np.float32(-np.inf))
        rows = np.flatnonzero(near.max(axis=1) >= floor)
        if not len(rows):
            return
        near, floor = near[rows], floor[rows]
        new = np.isneginf(floor)
        if new.any() and near.shape[1] > self.k:
            kth = np.partition(near[new], near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
            floor[new] = kth - np.float32(2.5 * self.slack)
        row, column = np.nonzero(near >= floor[:, None])
        owner = asked[rows[row]]
        score = np.empty(len(row))
        self.scored += len(row)
        for at in range(0, len(row), self.PIECE):
            part = slice(at, at + self.PIECE)
            score[part] = np.einsum("ij,ij->i", self.units[owner[part]], x[column[part]])
        score = np.round(score, 12)
        first = _leading_of(owner, score, column, self.k)
        first = first[~(score[first] < self.floor[owner[first]])]
        if not len(first):
            return
        owner, score = owner[first], score[first]
        self.found.append((owner, places[column[first]], score))
        mine, row = np.unique(owner, return_inverse=True)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        table = np.full((len(mine), self.k), -np.inf)
        table[row, np.arange(len(row)) - starts[row]] = np.nan_to_num(score, nan=-2.0)
        best = np.sort(np.concatenate([self.best[mine], table], axis=1), axis=1)[:, -self.k :]
        self.best[mine] = best
        self.floor[mine] = np.maximum(self.floor[mine], best[:, 0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score), the first k of every query."""
        if not self.found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        owner, place, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        first = _leading_of(owner, score, place, self.k)
        return owner[first], place[first], score[first]


def _top_k_pair(k: int):
    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Best k of one block of the corpus for one block of queries. Queries may name
        the ``parts`` (of the rows' ``part``) they search, and the ``least`` score that counts."""
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "score": np.empty(0)})
        rows = rows.sort_values("id", kind="stable")
        x, ids = _units(rows["v"]), rows["id"].to_numpy()
        search = TopK(_units(asked["v"]), k, asked["least"].to_numpy(dtype=float) if "least" in asked else None)
        if "parts" not in asked:
            search.add(x, np.arange(len(x)), np.arange(len(asked)))
        else:
            sizes = asked["parts"].map(len).to_numpy()
            owner, wanted = np.repeat(np.arange(len(asked)), sizes), np.concatenate(asked["parts"].tolist())
            part = rows["part"].to_numpy()
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                search.add(x[here], here, owner[wanted == p])
        query, place, score = search.result()
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[query], "id": ids[place], "score": score})

    return best


def _numbers(df: DataFrame, vector: str) -> Column:
    """The vector as it travels: floats stay floats, which takes half the room; tasks work in double precision."""
    return F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")


def top_k_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    query_vector: str = "vector",
    key: str = "id",
    vector: str = "vector",
    filters: Mapping[str, object] | None = None,
    query_block: int = QUERY_BLOCK,
    corpus_block: int = CORPUS_BLOCK,
) -> DataFrame:
    """The k most similar corpus rows of every query by cosine (ties by id), exact.

    Both sides are dealt by hash into blocks of about ``query_block`` and ``corpus_block`` rows; every pair of
    blocks is one group, which keeps k rows per query. No vector and no pair passes the driver."""

    def blocks(df: DataFrame, most: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(df.select(F.count(F.lit(1))).scalar() / F.lit(most))).cast("int")

    def dealt(df: DataFrame, name: str, own: str, mine: Column, other: str, others: Column) -> DataFrame:
        placed = df.withColumns({own: F.pmod(F.xxhash64(name), mine).cast("int"), other: others})
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    rows = _matching(corpus, filters).select(F.col(key).alias("id"), _numbers(corpus, vector).alias("v"))
    asked = queries.select(F.col(query_key).alias("query_id"), _numbers(queries, query_vector).alias("v"))
    corpus_blocks, query_blocks = blocks(rows, corpus_block), blocks(asked, query_block)
    left = dealt(rows, "id", "_cb", corpus_blocks, "_qb", query_blocks)
    right = dealt(asked, "query_id", "_qb", query_blocks, "_cb", corpus_blocks)
    kinds = {**dict(rows.dtypes), **dict(asked.dtypes)}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    found = left.groupBy("_cb", "_qb").cogroup(right.groupBy("_cb", "_qb")).applyInPandas(_top_k_pair(k), schema)
    return leading(found, ["query_id"], [F.desc("score"), "id"], k, "rank")


def _without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Items of keys that are not among the others, null being a key."""
    return base.join(gone.select(F.col(key).alias("_gone")), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")


def upsert_items(base: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Items with the new ones replacing those of the same key; of several new copies the latest."""
    latest = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), version).alias("r")).select("r.*")
    return _without(base, latest, key).unionByName(latest.select(*base.columns))


def delete_items(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return _without(base, gone, key)


def with_idf(frequency: DataFrame, n: Column) -> DataFrame:
    """(term, df) with ``idf``, over ``n`` texts."""
    return frequency.withColumn("idf", F.ln((n + 1) / (F.col("df") + 1)) + 1)


def asked_weights(known: DataFrame, question: str) -> dict[str, float]:
    """The question's L2-normalized TF-IDF weights over the terms of ``known`` (term, idf), by what a question holds."""
    spark = known.sparkSession
    said = spark.createDataFrame([(question,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term"))
    counts = {r.term: r.n for r in said.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # words of one question
    found = known.where(F.col("term").isin(list(counts))).select("term", "idf").collect() if counts else []
    raw = {r.term: counts[r.term] / max(counts.values()) * r.idf for r in found}
    length = math.sqrt(sum(x * x for x in raw.values()))
    return {term: x / length for term, x in raw.items()}


def semantic_search(
    corpus: DataFrame, key: str, text: str, question: str, limit: int | None = 10, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """Texts most similar to a question by TF-IDF cosine over the whole vocabulary of the corpus, as (key, score).

    For one question over a table; to ask more often, keep a ``textindex``. Lengths and products come from one
    aggregation over the terms, so nothing is laid out by term and back."""
    rows = _matching(corpus, filters)
    counts = stored(term_counts(rows, key, text))
    total = rows.select(F.count(F.lit(1))).scalar()
    frequency = counts.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = stored(with_idf(frequency, total))
    asked = asked_weights(known, question)
    wanted = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in asked.items() for x in item]), F.col("term")), F.lit(0.0)) if asked else F.lit(0.0)
    raw = F.col("count") / F.col("most") * F.col("idf")
    scored = by_term(counts, known.select("term", "idf"), known).groupBy(key).agg(F.sum(raw * wanted).alias("product"), F.sqrt(F.sum(raw * raw)).alias("length"))
    found = scored.select(key, F.round(F.col("product") / F.col("length"), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key)
    return found if limit is None else found.limit(limit)


def top_variance_dims(df: DataFrame, key: str, vector: str, dims: int = 2) -> DataFrame:
    """Vectors cut to the dimensions of largest population variance, largest first (ties by position)."""
    spread = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    top = spread.orderBy(F.desc("v"), "pos").limit(dims)
    places = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "pos"))), lambda s: s["pos"])).scalar()
    cut = df.select(key, vector).withColumn("_places", places)
    return cut.select(key, F.expr(f"transform(_places, p -> get(`{vector}`, p))").alias(vector))


def sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Compound score s/√(s²+15) over a lexicon of (term, valence), its label and a 50-letter snippet.

    The lexicon may be of any size: entries of frequent words are broadcast, so that only rare words are shuffled."""
    counts, known = stored(term_counts(df, key, text)), stored(lexicon.select("term", "valence"))
    frequency = stored(counts.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    scored = by_term(counts, known, frequency, "left").groupBy(key).agg(F.sum(F.col("count") * F.coalesce("valence", F.lit(0.0))).alias("s"))
    compound = F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)
    label = F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")
    snippets = df.select(key, F.substring(text, 1, 50).alias("snippet"))
    return scored.select(key, compound.alias("compound"), label.alias("label")).join(snippets, key)


def sentiment_breakdown(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("label") == name).alias(name) for name in ("positive", "negative", "neutral")],
        F.avg("compound").alias("mean_compound"),
    )


def keyword_search(df: DataFrame, columns: Sequence[str], question: str) -> DataFrame:
    """Rows that hold the text in one of the columns, in any case."""
    wanted = F.lower(F.lit(question))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return df.where(hit)
