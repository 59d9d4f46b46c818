"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text's lattice has a node per character and an edge per piece. Pieces hold white space only in front, so the
lattice of a text is a chain of small ones, a unit each (white space and the word after it). All units of a batch of
rows that the worker has not met yet are worked on together:

1. forward: the Viterbi score of the best path to every node, by one vector step per character place;
2. backward the same; an edge off the best path gives the best path that uses it, so the smallest loss of any
   other path of a unit is known;
3. the N best paths of a text differ from the best in no more units than the N - 1 of the smallest loss, so A*
   searches backward from the end through the lattices of these alone. The forward scores are the exact cost of
   what is left to the start, so a state is taken from the heap only if it lies on one of the N best paths or ties.

Scores are those of the model file. A character without a piece becomes its UTF-8 bytes, at one score below all.
White space other than blanks is kept as it is. Ties: the path whose last differing piece is longer comes first.

Null texts give no ids and one row of rank 1 with null ids; an empty text has one row of no ids. Repeated rows are
encoded as often as they come. Fewer segmentations than N give fewer rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 1_000_000


class Vocabulary:
    """Pieces, scores and a table of prefixes by length."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int):
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.byte_ids, self.unknown = byte_ids, unknown
        usable = [s for _, s in pieces.values() if s > -1e8] or [0.0]
        self.unknown_score = min(usable) - 10
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in pieces):
            raise ValueError("pieces must hold white space only in front")
        levels: list[dict[str, tuple[int, float]]] = [{} for _ in range(max(map(len, pieces), default=0))]
        for p, found in pieces.items():
            for n in range(1, len(p)):
                levels[n - 1].setdefault(p[:n], (-1, 0.0))
            levels[len(p) - 1][p] = found
        self.levels = []
        for level in levels:
            keys = np.array([_hash(p) for p in level], np.uint64)
            order = np.argsort(keys)
            self.levels.append((keys[order], np.array([i for i, _ in level.values()])[order], np.array([s for _, s in level.values()])[order]))


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return h


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Of a model file; once per Python worker."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    in_bytes = [i for i in every if sp.is_byte(i)]
    return Vocabulary(pieces, in_bytes or None, sp.unk_id())


def units_of(text: str) -> list[str]:
    return _UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lattices:
    """The lattices of a list of units."""

    def __init__(self, units: list[str], vocab: Vocabulary):
        self.vocab = vocab
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(u) for u in units], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # every unit's first node
        self.last = self.first + sizes
        owner = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[owner]
        left = sizes[owner] - place
        node = self.first[owner] + place
        sources, lengths, ids, scores = [], [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        for n, (keys, piece_ids, piece_scores) in enumerate(vocab.levels, 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _BASE + codes[at + n - 1] + np.uint64(1)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[slot] == h
            at, h, slot = at[known], h[known], slot[known]
            whole = piece_ids[slot] >= 0
            if n == 1:
                single[at[whole]] = True
            sources.append(at[whole])
            lengths.append(np.full(np.count_nonzero(whole), n))
            ids.append(piece_ids[slot[whole]])
            scores.append(piece_scores[slot[whole]])
        lone = np.flatnonzero(~single)
        sources.append(lone)
        lengths.append(np.ones(len(lone), np.int64))
        ids.append(-1 - codes[lone].astype(np.int64))
        scores.append(np.full(len(lone), vocab.unknown_score))
        at, n = np.concatenate(sources), np.concatenate(lengths)
        order = np.lexsort((-n, node[at] + n, place[at] + n))  # by place of the end, then end, longest piece first
        at, n = at[order], n[order]
        self.source, self.end = node[at], node[at] + n
        self.ids, self.score = np.concatenate(ids)[order], np.concatenate(scores)[order]
        self._places(place[at] + n, place[at])
        self._best_paths()

    def _places(self, ends: np.ndarray, starts: np.ndarray) -> None:
        nodes, none = int(self.last[-1]) + 1, -np.inf
        self.forward = np.full(nodes, none)
        self.forward[self.first] = 0
        self.into = np.full(nodes, -1)  # the best edge into a node
        for lo, hi in _stretches(ends):
            to = self.end[lo:hi]
            gain = self.forward[self.source[lo:hi]] + self.score[lo:hi]
            group = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            best = np.maximum.reduceat(gain, group)
            self.forward[to[group]] = best
            hit = np.where(gain == np.repeat(best, np.diff(np.append(group, hi - lo))), np.arange(lo, hi), len(self.end))
            self.into[to[group]] = np.minimum.reduceat(hit, group)
        self.backward = np.full(nodes, none)
        self.backward[self.last] = 0
        back = np.lexsort((self.source, -starts))
        for lo, hi in _stretches(starts[back]):
            edges = back[lo:hi]
            of = self.source[edges]
            gain = self.backward[self.end[edges]] + self.score[edges]
            group = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            self.backward[of[group]] = np.maximum.reduceat(gain, group)

    def _best_paths(self) -> None:
        """Every unit's best path, and the loss of its next best (inf if there is none)."""
        count = len(self.first)
        now, alive, steps = self.last.copy(), np.arange(count), []
        on_best = np.zeros(len(self.end), bool)
        while len(alive):
            edge = self.into[now[alive]]
            on_best[edge] = True
            steps.append((alive, edge))
            now[alive] = self.source[edge]
            alive = alive[now[alive] > self.first[alive]]
        units = np.concatenate([u for u, _ in steps]) if steps else np.empty(0, np.int64)
        edges = np.concatenate([e for _, e in steps]) if steps else np.empty(0, np.int64)
        order = np.lexsort((self.end[edges], units))
        self.path = edges[order]
        self.path_size = np.bincount(units, minlength=count)
        self.path_start = np.cumsum(self.path_size) - self.path_size
        self.best = self.forward[self.last]
        off = np.flatnonzero(~on_best)
        through = np.full(count, -np.inf)
        of = np.searchsorted(self.first, self.source[off], side="right") - 1
        np.maximum.at(through, of, self.forward[self.source[off]] + self.score[off] + self.backward[self.end[off]])
        self.loss = self.best - through
        # Edges by their end, for the search.
        order = np.lexsort((-(self.end - self.source), self.end))
        self.by_end = order
        self.end_start = np.searchsorted(self.end[order], np.arange(len(self.forward) + 1))

    def tokens(self, edges) -> list[int]:
        """Ids of edges; a character without a piece gives its bytes."""
        out = []
        for i in self.ids[np.asarray(edges, dtype=np.int64)].tolist():
            if i >= 0:
                out.append(i)
            elif self.vocab.byte_ids:
                out += [self.vocab.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.vocab.unknown)
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all best paths, joined, and how many each unit has."""
        ids = self.ids[self.path]
        strange = np.flatnonzero(ids < 0)
        if not len(strange):
            return ids, self.path_size.copy()
        parts, sizes, at = [], np.ones(len(ids), np.int64), 0
        for i in strange.tolist():
            more = self.tokens([self.path[i]])
            parts += [ids[at:i], np.array(more)]
            sizes[i], at = len(more), i + 1
        parts.append(ids[at:])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate(parts), total[self.path_start + self.path_size] - total[self.path_start]

    def others(self, chain: list[int], n: int) -> list[tuple[float, list[list[int] | None]]]:
        """Backward A* through the lattices of ``chain``: the ``n`` best paths as (score, edges per unit)."""
        before = [0.0]
        for u in chain:
            before.append(before[-1] + float(self.best[u]))
        k, tick, found = len(chain) - 1, 0, []
        heap = [(-before[-1], 0, k, int(self.last[chain[k]]), 0.0, None)]
        while heap and len(found) < n:
            f, _, k, node, tail, path = heappop(heap)
            if node == self.first[chain[k]]:
                if k == 0:
                    split: list[list[int]] = [[] for _ in chain]
                    while path is not None:
                        (i, edge), path = path
                        split[i].append(edge)
                    found.append((-f, split))
                    continue
                k -= 1
                node = int(self.last[chain[k]])
            for edge in self.by_end[self.end_start[node] : self.end_start[node + 1]].tolist()[::-1]:
                source = int(self.source[edge])
                total = tail + float(self.score[edge])
                tick -= 1  # of equal scores the newest state first: ties are followed to the start, not fanned out
                heappush(heap, (-(before[k] + float(self.forward[source]) + total), tick, k, source, total, ((k, edge), path)))
        return found


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of every stretch of equal neighbours."""
    cut = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cut.tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


#: Score of a chain's best path, and of its next ones with what they change: (unit's place in the chain, ids).
Split = tuple[float, list[tuple[float, list[tuple[int, list[int]]]]]]


class Units:
    """The best segmentations of the units a worker has met, up to a number of them; beyond that it starts anew."""

    def __init__(self, vocab: Vocabulary, most: int = 300_000):
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.best = np.empty(0)
        self.loss = np.empty(0)
        self.ranks: dict[tuple[int, ...], Split] = {}

    def chains(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of every text's units; new units are segmented."""
        if len(self.index) > self.most:
            self.clear()
        index, held = self.index, len(self.index)
        chains = [np.array([index.setdefault(u, len(index)) for u in units_of(t or "")], np.int64) for t in texts]
        new = list(islice(index, held, None))
        if new:
            lattice = Lattices(new, self.vocab)
            ids, sizes = lattice.flat()
            self.names += new
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.best = np.concatenate([self.best, lattice.best])
            self.loss = np.concatenate([self.loss, lattice.loss])
        return chains


Ranks = list[tuple[float, list[tuple[int, int, list[int]]]]]


def _least(loss: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least losses that are finite, in order; of equal losses the first."""
    if len(loss) > most:
        bound = np.partition(loss, most - 1)[most - 1] if most else -np.inf
        below = np.flatnonzero(loss < bound)
        pick = np.sort(np.concatenate([below, np.flatnonzero(loss == bound)[: most - len(below)]]))
    else:
        pick = np.arange(len(loss))
    return pick[np.isfinite(loss[pick])]


def _others(keys: set[tuple[int, ...]], units: Units, n: int) -> None:
    """Find the best paths through every chain of opened units that was not met before."""
    numbers = sorted({u for k in keys for u in k})
    if not numbers:
        return
    lattice = Lattices([units.names[u] for u in numbers], units.vocab)
    local = {u: i for i, u in enumerate(numbers)}
    for key in keys:
        held = [local[u] for u in key]
        own = [lattice.path[lattice.path_start[u] : lattice.path_start[u] + lattice.path_size[u]].tolist() for u in held]
        base = sum(float(lattice.best[u]) for u in held)
        paths = [p for p in lattice.others(held, n) if p[1] != own][: n - 1]
        changed = [(score, [(i, lattice.tokens(e)) for i, (e, mine) in enumerate(zip(split, own, strict=True)) if e != mine]) for score, split in paths]
        units.ranks[key] = base, changed


def segment(texts: list[str | None], units: Units, n: int) -> tuple[np.ndarray, np.ndarray, list[Ranks]]:
    """(ids of all texts' best segmentations, how many each has, per text [(score, changes)] by rank); a change
    is (place in the best ids, how many it takes out, the ids it puts in). Texts that open the same units in the
    same order share one search."""
    chains = units.chains(texts)
    sizes = units.sizes
    chain = np.concatenate([np.empty(0, np.int64), *chains])
    counts = sizes[chain]
    gather = np.repeat(units.starts[chain] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    lengths = np.array([int(sizes[c].sum()) for c in chains], np.int64)
    opened = [_least(units.loss[c], n - 1) for c in chains]  # per text, the places of the units that may differ
    keys = [tuple(c[o].tolist()) for c, o in zip(chains, opened, strict=True)]
    if len(units.ranks) > units.most:
        units.ranks.clear()
    _others({k for k in keys if k and k not in units.ranks}, units, n)
    ranked: list[Ranks] = []
    for c, places, key in zip(chains, opened, keys, strict=True):
        best = float(units.best[c].sum())
        ranks: Ranks = [(best, [])]
        if key:
            base, changed = units.ranks[key]
            ends = np.cumsum(sizes[c])
            at, own = (ends[places] - sizes[c[places]]).tolist(), sizes[c[places]].tolist()
            ranks += [(best - base + score, [(at[i], own[i], ids) for i, ids in changes]) for score, changes in changed]
        ranked.append(ranks)
    return units.ids[gather], lengths, ranked


CHANGE = "array<struct<at:int,removed:int,ids:array<int>>>"
_CHANGE = pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))]))


def encode(df: DataFrame, model: str, n: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text and rank: (``key``, rank, score, n_ids, ids, changes, text_crc32, decoded_crc32). The best
    segmentation comes with its ``ids``; the others with their ``changes`` to the best's, which ``expand`` turns into
    ids. The checksums are of the text and of what the ids decode to; they differ where a text holds the mark that
    stands for a blank, or bytes that are no UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, pieces = Units(vocabulary(model)), piece_bytes(vocabulary(model))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                until, size = at, 0
                while until < len(texts) and size < _BATCH:
                    size += len(texts[until] or "")
                    until += 1
                part = texts[at:until]
                ids, lengths, ranked = segment(part, units, n)
                per = np.array([len(r) for r in ranked])
                owner = np.repeat(np.arange(len(part)), per)
                first = np.concatenate([[0], np.cumsum(per)[:-1]])
                held = np.zeros(len(owner), np.int64)
                held[first] = lengths
                best = np.zeros(len(owner), bool)
                best[first] = True
                absent = ~best
                absent[first[[t is None for t in part]]] = True
                changes = [None if is_best else [{"at": a, "removed": x, "ids": i} for a, x, i in c] for is_best, (_, c) in zip(best.tolist(), (r for rs in ranked for r in rs), strict=True)]
                n_ids = lengths[owner] + np.array([sum(len(c["ids"]) - c["removed"] for c in cs or ()) for cs in changes], np.int64)
                offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                crc = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in part])
                ends = np.cumsum(lengths)
                back = np.array([zlib.crc32(decoded(ids[e - x : e], pieces).encode("utf-8", "surrogatepass")) for e, x in zip(ends.tolist(), lengths.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(owner + at)),
                        pa.array(np.arange(len(owner)) - np.repeat(first, per) + 1, pa.int32()),
                        pa.array([s for rs in ranked for s, _ in rs], pa.float64()),
                        pa.array(n_ids),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=pa.array(absent)),
                        pa.array(changes, _CHANGE),
                        pa.array(crc[owner], pa.int64()),
                        pa.array(back[owner], pa.int64()),
                    ],
                    ["doc_id", "rank", "score", "n_ids", "ids", "changes", "text_crc32", "decoded_crc32"],
                )
                at = until

    kind = dict(df.dtypes)[key]
    encoded = df.select(key, text).mapInArrow(run, f"doc_id {kind}, rank int, score double, n_ids long, ids array<int>, changes {CHANGE}, text_crc32 long, decoded_crc32 long")
    return encoded.withColumnRenamed("doc_id", key)


def expand(best: list[int], changes: list[tuple[int, int, list[int]]] | None) -> list[int]:
    """The ids of a segmentation out of the best one's."""
    out, at = [], 0
    for start, removed, ids in changes or ():
        out += [*best[at:start], *ids]
        at = start + removed
    return out + list(best[at:])


def piece_bytes(vocab: Vocabulary) -> dict[int, bytes]:
    return {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in vocab.text.items()} | {i: bytes([b]) for b, i in enumerate(vocab.byte_ids or ())}


def decoded(ids: np.ndarray, pieces: dict[int, bytes]) -> str:
    get = pieces.get
    return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def decode(ids: Column, model: str) -> Column:
    """Text of an array of ids; null stays null. Ids of no piece give nothing; broken bytes U+FFFD."""

    @F.pandas_udf("string")
    def texts(arrays: pd.Series) -> pd.Series:
        pieces = piece_bytes(vocabulary(model))
        return pd.Series([None if a is None else decoded(a, pieces) for a in arrays])

    return texts(ids)
