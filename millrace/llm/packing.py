"""Bounded-space online best-fit packing of token sequences.

Each task tokenizes and packs the rows of its own partition in the order it reads them, with no shuffle. It
holds a fixed number of open bins and a bitset with one bit per amount of free space: shifting the bitset by
the piece's length and taking its lowest bit finds the tightest bin in one step. If none fits and no more may
be open, the fullest closes first. A bin's number holds the partition's number, so numbers never clash and a
task that runs again gives the same ones.

Documents longer than a bin are cut into pieces of a whole bin each; the first piece takes the remainder.

A null text counts as empty; an empty text is one piece of the end mark alone. Repeated rows are packed as
often as they come. An empty table gives no rows. Memory: one batch of rows and the open bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Fixed value: how byte-level BPE of this family splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_BINS = 256


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest
    in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """ids(text) for a byte-level BPE tokenizer file; once per Python worker.

    The vocabulary's ids are its merge ranks, so the faster of the two libraries can read it. A text that this
    one refuses (very long runs of white space), or that holds a special token, which the tokenizer reads as one
    id, goes to the other."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(token in text for token in special):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return ids


class Packer:
    """Open bins of one task."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.open_bins, self.next = size, open_bins, first
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]  # per free space: numbers of open bins
        self.count = 0

    def _take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.free ^= 1 << room
        self.count -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Place a piece: (bin, offset)."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            if self.count >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            room, number = self.size, self.next
            self.next += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.size - room


def cuts(length: int, size: int) -> list[int]:
    """Lengths of a document's pieces."""
    first = length % size
    return [first] * (first > 0) + [size] * (length // size)


SCHEMA = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(df: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, open_bins: int = OPEN_BINS, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, where it lies in which sequence, and a checksum
    of its ids, which come along as ``ids`` if asked for. ``tokenizer`` is the path of the tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        context = TaskContext.get()
        packer = Packer(size, open_bins, (context.partitionId() if context else 0) << 33)
        for batch in batches:
            keys, rows, ids = [], [], []

            def flush(kind=batch.schema.field(0).type):
                columns = [pa.array(keys, kind)]
                numbers = np.array(rows, dtype=np.int64).reshape(-1, 6)
                columns += [pa.array(numbers[:, i].astype(np.int32) if i == 0 else numbers[:, i]) for i in range(6)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(columns, names)

            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.array([*ids_of(t.as_py() or ""), end], dtype="<u4")
                start = 0
                for piece, length in enumerate(cuts(len(tokens), size)):
                    part = tokens[start : start + length]
                    keys.append(k.as_py())
                    rows.append((piece, start, length, zlib.crc32(part.tobytes()), *packer.put(length)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    start += length
                if len(rows) >= 5000:
                    yield flush()
                    keys, rows, ids = [], [], []
            if rows:
                yield flush()

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, SCHEMA.format(kind) + (", ids array<int>" if with_ids else ""))
