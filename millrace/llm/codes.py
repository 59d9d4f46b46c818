"""Vector code compression: product codes from exact integer arithmetic, multiplied by floating-point units.

Components become integers, floor(scale * x). A vector is cut into ``PARTS`` equal consecutive parts, and each
part position has a codebook of integer entries. Squared distances |v|^2 - 2 v.c + |c|^2 are exact: integers
are split into limbs so short that a matrix product of limbs stays below 2^53, where doubles are exact; the
products are recombined in 64-bit integers, and the first of the least is taken. The codebooks of a round come from
the sums and counts of the parts next to each entry, which are added up per task and then per entry and
component; so the driver sees at most ``PARTS * ENTRIES`` entries, whatever the table, and codebooks travel with the
code. No row is shuffled but for the sums per label.

Integers beyond what distances in 64 bits allow are worked on as Python integers, exactly too; an error
beyond 64 bits is null. Sums are decimals of 38 digits.

Left out are rows whose vector is null, holds null or non-finite components, or has another length than that of
the smallest id left. A length that ``PARTS`` does not divide is filled up with zeros. Null ids come last,
rows of equal id are ordered by their vector. With fewer vectors than entries, codebooks are smaller; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.order import join_totals

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_EXACT_BITS = 53  # of a double

#: Per part, per entry: the integer components.
Codebooks = list[list[list[int]]]


def usable(vector: str | Column) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    column = F.col(vector) if isinstance(vector, str) else vector
    wide = column.cast("array<double>")
    return F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value) as 64-bit integers, or Python's if some do not fit."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled.ravel()) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = [n * scale // d for n, d in (float(x).as_integer_ratio() for x in values.ravel())]
    return np.array(exact, object).reshape(values.shape)


def cut(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, length) as (parts, rows, length of a part)."""
    width = -(-vectors.shape[1] // parts)
    filled = np.zeros((len(vectors), parts * width), vectors.dtype)
    filled[:, : vectors.shape[1]] = vectors
    return filled.reshape(len(vectors), parts, width).transpose(1, 0, 2)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles l with values = sum(l[i] << (bits * i)): each of ``bits`` bits from zero up, the last one with the
    sign and at most that long."""
    found, rest = [], values
    while len(rest.ravel()) and (rest.min() < -(1 << bits) or rest.max() > 1 << bits):
        found.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*found, rest.astype(np.float64)]


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products (…, n, width) by (…, m, width) of integers whose results fit 64 bits."""
    bits = (_EXACT_BITS - 1 - max(left.shape[-1], 1).bit_length()) // 2
    total = np.zeros((*left.shape[:-1], right.shape[-2]), np.int64)
    for i, x in enumerate(limbs(left, bits)):
        for j, y in enumerate(limbs(right, bits)):
            total += (x @ np.swapaxes(y, -1, -2)).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part and row, the first nearest entry and its squared distance."""
    width = max(parts.shape[-1], 1)
    most = max((int(np.abs(x).max()) for x in (parts, books) if x.size), default=0)
    if parts.dtype == object or books.dtype == object or 4 * width * most * most >= 1 << 62:
        step = parts.astype(object)[:, :, None, :] - books.astype(object)[:, None, :, :]
        distance = (step * step).sum(axis=-1)
    else:
        distance = (parts * parts).sum(axis=-1)[:, :, None] - 2 * dot(parts, books) + (books * books).sum(axis=-1)[:, None, :]
    index = distance.argmin(axis=-1)
    return index, np.take_along_axis(distance, index[..., None], axis=-1)[..., 0]


def _book_array(books: Codebooks) -> np.ndarray:
    most = max((abs(x) for part in books for entry in part for x in entry), default=0)
    return np.array(books, np.int64 if most < 1 << 62 else object)


def _parts(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return cut(integers(flat.reshape(len(vectors), -1)))


@dataclass(frozen=True)
class Coder:
    """Fitted codebooks. ``length`` is that of the vectors."""

    books: Codebooks
    length: int

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and place, joined by commas."""
        flat = ",".join(str(x) for part in self.books for entry in part for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def encode(self, rows: DataFrame, vector: str, keep: dict[str, str]) -> DataFrame:
        """The columns of ``keep`` (name: new name) with ``code`` and ``error``, for vectors of the coder's length."""
        books = self.books
        narrow = _narrow(rows, vector, self.length, **keep)
        kept = [f for f in narrow.schema.fields if f.name != "vector"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code string, error long"

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = _book_array(books)
            for batch in batches:
                if len(batch):
                    index, distance = nearest(_parts(batch.column("vector")), entries)
                    codes = [row.tobytes().hex() for row in index.T.astype(np.uint8)]
                    errors = [e if e < 1 << 63 else None for e in distance.sum(axis=0).tolist()]
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*(f.name for f in kept), "code", "error"])

        return narrow.mapInArrow(code, schema)


def _narrow(rows: DataFrame, vector: str, length: int, **columns: str) -> DataFrame:
    right = usable(vector) & (F.size(vector) == length)
    return rows.where(right).select(*[F.col(c).alias(name) for c, name in columns.items()], F.col(vector).cast("array<double>").alias("vector"))


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, componentwise sums) of the parts nearest to each (part, entry)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _book_array(books)
        shape = entries.shape
        counts, totals = np.zeros(shape[:2], np.int64), np.zeros(shape, object)
        for batch in batches:
            if not len(batch):
                continue
            parts = _parts(batch.column("vector"))
            index, _ = nearest(parts, entries)
            for p, e in np.ndindex(*shape[:2]):
                own = index[p] == e
                if own.any():
                    counts[p, e] += own.sum()
                    totals[p, e] += parts[p][own].sum(axis=0).astype(object)
        at = np.argwhere(counts[..., None].repeat(shape[2], axis=-1) > 0)
        if len(at):
            p, e, i = at.T
            columns = [pa.array(x.astype(np.int32)) for x in (p, e, i)]
            numbers = [pa.array(counts[p, e]), pa.array([int(x) for x in totals[p, e, i]], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], ["part", "entry", "place", "count", "total"])

    added = rows.mapInArrow(add, "part int, entry int, place int, count long, total decimal(38,0)")
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    # at most PARTS * ENTRIES * length of a part rows
    for r in added.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("total").alias("total")).orderBy("part", "entry", "place").collect():
        found.setdefault((r.part, r.entry), (r["count"], []))[1].append(int(r.total))
    return found


def fit(rows: DataFrame, key: str, vector: str, rounds: int = ROUNDS, entries: int = ENTRIES) -> Coder | None:
    """Codebooks that begin as the parts of the ``entries`` smallest keys and follow their parts' means, rounded
    down, for so many rounds; entries without parts stay. None without vectors."""
    good = rows.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    smallest = [F.col("key").asc_nulls_last(), F.col("vector").asc()]
    first = good.orderBy(*smallest).limit(1).collect()
    if not first:
        return None
    length = len(first[0].vector)
    start = good.where(F.size("vector") == length).orderBy(*smallest).limit(entries).collect()
    books: Codebooks = cut(integers(np.array([r.vector for r in start], np.float64).reshape(len(start), length))).tolist()
    narrow = _narrow(rows, vector, length)
    for _ in range(rounds if length else 0):
        for (part, entry), (count, totals) in _sums(narrow, books).items():
            books[part][entry] = [total // count for total in totals]
    return Coder(books, length)


def compress(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of every vector that is not left out. The code has
    two hex digits for each part; ``label_error`` is the error summed over equal labels, nulls together."""
    coder = fit(rows, key, vector)
    if coder is None:
        empty = rows.select(F.col(key).alias("key"), F.col(label).alias("label")).where("false")
        blank = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return empty.withColumns({name: F.lit(None).cast(kind) for name, kind in blank.items()})
    coded = freeze(coder.encode(rows, vector, {key: "key", label: "label"}))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_totals(coded, totals, ["label"]).withColumn("codebooks_sha256", F.lit(coder.digest()))
