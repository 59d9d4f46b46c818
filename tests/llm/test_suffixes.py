import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffixes

SCHEMA = "doc_id long, text string, repeats_ string"


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    met = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if met[r[i : i + width]] > 1:
                gone[i : i + width] = True
        gone = gone[: len(r)]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        edges = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        out.append((len(r), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    draw = random.Random(5)
    for _ in range(200):
        s = [draw.randrange(1, 4) for _ in range(draw.randrange(40))] + [0]
        order = suffixes.suffix_array(s, 4)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        _, shared = suffixes.permuted_prefixes(s, order)
        for x, y in zip(order, order[1:], strict=False):
            assert s[x : x + shared[y]] == s[y : y + shared[y]] and s[x + shared[y]] != s[y + shared[y]]


def test_every_window_is_in_one_run_and_equal_windows_pick_equal_grams():
    draw = random.Random(6)
    texts = [bytes(draw.choices(b"ab", k=draw.randrange(80))) for _ in range(40)]
    width, gram = 20, 7
    owner, place, start, count, hashes, picks = suffixes.runs_of(texts, width, gram)
    seen, picked = set(), {}
    joined = b"".join(texts)
    for o, p, s, c, h, g in zip(owner, place, start, count, hashes, picks, strict=True):
        for k in range(c):
            window = texts[o][p + k : p + k + width]
            assert len(window) == width and joined[s + k : s + k + width] == window
            assert (o, p + k) not in seen
            seen.add((o, p + k))
            assert picked.setdefault(window, (h, g - k)) == (h, g - k)
    assert len(seen) == sum(max(0, len(t) - width + 1) for t in texts)


def corpus(seed):
    draw = random.Random(seed)
    prose = lambda n: "".join(draw.choices("abcdefgh éñ\n", k=n))
    passages = [prose(n) for n in (20, 30, 45, 90)]
    texts = [None, "", "short", "aaaa" * 30, prose(200), prose(19)]
    for _ in range(60):
        parts = [prose(draw.randrange(60)) for _ in range(3)]
        texts.append(parts[0] + draw.choice(passages) + parts[1] + draw.choice(passages)[draw.randrange(10) :] + parts[2])
    texts += [texts[10]] * 5 + [texts[11][:-1] + "x"]
    return texts


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"gram_bytes": 100}, {"cores": 1}, {"cores": 40, "gram": 20}])
def test_matches_brute_force(spark, options):
    texts = corpus(9)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    done = suffixes.remove_repeats(df, **{"width": 25, "gram": 8, "with_text": True, **options})
    assert done.columns == [*df.columns, "repeats"]
    got = {r.doc_id: r.repeats for r in done.collect()}
    want = brute(texts, 25)
    assert [(q.n_bytes, q.n_removed, q.n_spans, q.kept_sha256) for q in (got[i] for i in range(len(texts)))] == want


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_words(texts, width, words):
    """What is left if both the repeated strings of ``width`` bytes and the repeated runs of ``words`` words go."""
    raws = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    runs = [[tuple(r[a:b] for a, b in p[i : i + words]) for i in range(len(p) - words + 1)] for r, p in zip(raws, places, strict=True)]
    met = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    met_runs = Counter(run for found in runs for run in found)
    out = []
    for r, p, found in zip(raws, places, runs, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if met[r[i : i + width]] > 1:
                gone[i : i + width] = True
        for i, run in enumerate(found):
            if met_runs[run] > 1:
                gone[p[i][0] : p[i + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"gram_bytes": 100}, {"cores": 1}])
def test_runs_of_words_match_brute_force(spark, options):
    draw = random.Random(12)
    prose = lambda n: "".join(draw.choice(["a", "of", "thé", "lantern", "x1"]) + draw.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))
    passages = [prose(n) for n in (5, 6, 9, 15, 40)]
    texts = [None, "", " ", "a " * 40, prose(300), prose(6)]
    texts += [prose(draw.randrange(8)) + draw.choice(passages) + prose(draw.randrange(8)) + draw.choice(passages).replace(" ", "\n") for _ in range(60)]
    texts += [texts[10]] * 3
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    done = suffixes.remove_repeats(df, **{"width": 60, "gram": 16, "words": 9, **options})
    got = {r.doc_id: r.repeats.kept_sha256 for r in done.collect()}
    assert [got[i] for i in range(len(texts))] == [hashlib.sha256(k).hexdigest() for k in brute_words(texts, 60, 9)]


def test_grams_of_a_shard_are_sorted_by_themselves(monkeypatch):
    rng = random.Random(3)
    rows = []
    for gram in range(6):
        shared = bytes(rng.choices(range(97, 101), k=30))
        rows += [(gram, f"{gram}{i}".encode(), bytes([65 + i]) + shared[i:] + bytes([75 + i])) for i in range(3)]
    sizes, whole = [], suffixes.suffix_array
    want = dict(zip([r[1] for r in rows], suffixes.repeated_windows([r[2] for r in rows], 20), strict=True))
    monkeypatch.setattr(suffixes, "suffix_array", lambda s, symbols: (sizes.append(len(s)), whole(s, symbols))[1])
    got = dict(suffixes.repeated_by_gram(rows, 20))
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()} and any(v.any() for v in got.values())
    assert max(sizes) <= 100 and sum(n > 90 for n in sizes) == 6


def test_only_segments_with_partners_are_stored(spark, monkeypatch):
    stored, whole = [], suffixes.freeze
    monkeypatch.setattr(suffixes, "freeze", lambda df: (stored.append(done := whole(df)), done)[1])
    texts = corpus(9)
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.repeats for r in suffixes.remove_repeats(df, width=25, gram=8).collect()}
    assert [(q.n_bytes, q.n_removed, q.n_spans, q.kept_sha256) for q in (got[i] for i in range(len(texts)))] == brute(texts, 25)
    assert [d.columns for d in stored if "bytes" in d.columns] == [["gram", "seg", "pick", "bytes"]]
