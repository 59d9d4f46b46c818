"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two models of order one are trained on labelled samples of the corpus itself: characters of random strings
(what the patterns capture) and characters of ordinary words. A candidate (a long run of token characters)
is a secret if the mean log-likelihood ratio per character passes a threshold. Training counts character
pairs over all documents, per batch and then in one sum, so the table that reaches the driver has at most
(characters + 1) squared rows per label, whatever the corpus; both models fall back on single
characters and these on adding one, so an empty corpus gives uniform models, which name nothing.

Positions are code points, ends exclusive. Null texts count as empty. Very long texts are scanned whole.
Repeated rows are scanned alike. Matches of one kind do not overlap; kinds may.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they are listed; the method's own comes last.
KINDS = ("assign", "access", "hex")
LEARNED = "markov"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Of a maximal run, only its length can make it fail, so the bound may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_PART = re.compile("[A-Za-z0-9]+")
_START = ""
CANDIDATE_LENGTH, THRESHOLD, BACKOFF = 20, 1.0, 10.0
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def parts_of(token: str) -> list[str]:
    """Stretches of letters and digits between separators, but for numbers."""
    return [p for p in _PART.findall(token) if not p.isdigit()]


def _pairs(token: str) -> Iterator[tuple[str, str]]:
    for part in parts_of(token):
        before = _START
        for c in part:
            yield before, c
            before = c


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """(label, before, after, n): character pairs of captured strings (label 1) and of ordinary words (0).

    An ordinary word lies in no span and is made of letters, joined by ``-`` or ``_`` at most, as identifiers
    of people's making mostly are."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words: Counter[tuple[int, str]] = Counter()
            for t in frame.iloc[:, 0]:
                t = t or ""
                spans = base_spans(t)
                words.update((1, _secret(t, s)) for s in spans)
                taken = [s[:2] for s in spans]
                for m in _WORD.finditer(t) if taken else ():
                    if not any(a < m.end() and m.start() < b for a, b in taken):
                        words[0, m.group()] += 1
                if not taken:
                    words.update((0, w) for w in _WORD.findall(t))
            counts: Counter[tuple[int, str, str]] = Counter()
            for (label, word), n in words.items():
                if label or not any(c.isdigit() for c in word):
                    for a, b in _pairs(word):
                        counts[label, a, b] += n
            if counts:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["label", "before", "after", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInPandas(count, "label int, before string, after string, n long")
    return counted.groupBy("label", "before", "after").agg(F.sum("n").alias("n"))


def _secret(text: str, span: tuple[int, int, str]) -> str:
    """The random part of a captured span."""
    got = text[span[0] : span[1]]
    return _ASSIGN.match(got).group(2) if span[2] == "assign" else got


Model = dict[tuple[str, str], float]


def _chance(pairs: Counter, before: str, after: str, alone: Counter, total: int, from_before: Counter) -> float:
    """A pair's chance, drawn towards that of its second character, which is smoothed by adding one."""
    single = (alone[after] + 1) / (total + len(ALPHABET))
    return (pairs[before, after] + BACKOFF * single) / (from_before[before] + BACKOFF)


def train(docs: DataFrame, text: str) -> Model:
    """Log-likelihood ratio of every character pair: random against ordinary.

    Half of the random model is uniform, for what the patterns capture is often of one kind only."""
    pairs = {0: Counter(), 1: Counter()}
    for row in pair_counts(docs, text).collect():  # at most 2 * (len(ALPHABET) + 1) * len(ALPHABET) rows
        pairs[row.label][row.before, row.after] = row.n
    alone, heads = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for label, counted in pairs.items():
        for (before, after), n in counted.items():
            alone[label][after] += n
            heads[label][before] += n
    model = {}
    for before in (_START, *ALPHABET):
        for after in ALPHABET:
            p = {x: _chance(pairs[x], before, after, alone[x], sum(alone[x].values()), heads[x]) for x in pairs}
            model[before, after] = math.log((p[1] + 1 / len(ALPHABET)) / 2 / p[0])
    return model


def score(token: str, model: Model) -> float:
    """Mean log-likelihood ratio per character of the token's parts."""
    ratios = [model[p] for p in _pairs(token)]
    return sum(ratios) / max(len(ratios), 1)


def learned_spans(text: str, taken: list[tuple[int, int, str]], model: Model, threshold: float) -> list[tuple[int, int, str]]:
    """Candidates outside the given spans that look more random than ordinary. A candidate needs a
    part with both a digit and a letter: numbers and words, joined or not, are no secrets."""
    found = []
    for m in _CANDIDATE.finditer(text):
        token = m.group()
        if any(a < m.end() and m.start() < b for a, b, _ in taken):
            continue
        if any(not p.isalpha() for p in parts_of(token)) and score(token, model) > threshold:
            found.append((m.start(), m.end(), LEARNED))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, text: str, model: Model | None = None, threshold: float = THRESHOLD, out: str = "secrets", redact: Callable[[str], str] | None = None) -> DataFrame:
    """Add the struct ``out``: counts per fixed kind, a digest of the fixed spans, all spans, and with
    ``redact`` (kind to replacement) the text with every span replaced; else ``redacted`` is null.

    Without a model, one is trained on ``docs`` first."""
    model = train(docs, text) if model is None else model
    order = (*KINDS, LEARNED)

    @F.pandas_udf(SCHEMA)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            raw, t = t, t or ""
            base = base_spans(t)
            spans = sorted(base + learned_spans(t, base, model, threshold), key=lambda s: (s[0], order.index(s[2])))
            kinds = Counter(s[2] for s in base)
            clean = _replaced(t, spans, redact) if redact and spans else raw if redact else None
            rows.append((*(kinds[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), clean))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return docs.withColumn(out, find(F.col(text)))


def _replaced(text: str, spans: list[tuple[int, int, str]], redact: Callable[[str], str]) -> str:
    """Overlapping spans become one replacement, named by the first."""
    parts, at, until = [], 0, 0
    for start, end, kind in spans:
        if start >= until:
            parts += [text[until:start], redact(kind)]
            until = end
        else:
            until = max(until, end)
        at = until
    return "".join(parts) + text[at:]
