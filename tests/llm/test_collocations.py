import random
import re
from collections import Counter
from itertools import pairwise

import pytest

from millrace.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent=80, scale=2_000_000, top=None):
    counts = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                counts.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    found = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            longer = (q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * good[q] >= percent * a for q in longer):
                score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "A", "ça", "日本", "de", "la", "x-y", " q"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "! ", " ; "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return [(rng.choice(["en", "en", "en", "fr", None, "und"]), t) for t in texts] + [("en", None), ("en", ""), (None, ".,!"), ("zz", None)] + [("fr", "de la x")] * 7


@pytest.mark.parametrize("slice_bytes", [200, 1 << 20])
def test_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(collocations, "MERGE_ENTRIES", 10)
    rows = corpus(slice_bytes)
    docs = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4).collect())
    assert got == brute(rows, 4) and len(got) > 40
    top = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=3).collect())
    assert top == brute(rows, 4, top=3)


def test_a_full_bitmap_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_pair_filter", lambda pairs: b"\xff" * (collocations.FILTER_BITS // 8))
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=4).collect()) == brute(rows, 4)


def test_long_texts_hot_words_and_empty_tables(spark):
    long = "the end of the line " * 30_000
    rows = [("en", long), ("en", "the " * 500), ("en", "the end of")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=30).collect()) == brute(rows, 30)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_the_longest_text_of_a_slice_ends_words_at_its_end():
    import pyarrow as pa

    words = collocations.Words(pa.array(["ab c", "", "d", "e,f g"], pa.large_string()))
    known = words.known.to_pylist()
    assert [known[c] for c in words.code] == ["ab", "c", "d", "e", "f", "g"]
    assert [bool(a == b) for a, b in pairwise(words.piece)] == [True, False, False, False, True]
    assert words.follows(2).tolist() == [0, 4]
