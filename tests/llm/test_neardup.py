import random
import re

import pytest

from millrace.llm import neardup
from millrace.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, class string"


def brute(rows, n, percent):
    sets = []
    for _, text, _ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(lowered)
        width = min(n, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g) for g in set(group)}
    return {r[0]: (len(s), least[g], least[g] == r[0]) for r, s, g in zip(rows, sets, group, strict=True)}


def corpus(seed, families, size):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "One", "one", "two words", "TWO words", "É é", "é É", "a b c", "a b c a b c", "x " * 3000]
    for _ in range(families):
        base = draw.choices(vocabulary, k=draw.randrange(20, 120))
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randrange(5)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append(draw.choice([" ", "\n"]).join(words))
    texts += [" ".join(draw.choices(vocabulary, k=60)) for _ in range(30)]
    draw.shuffle(texts)
    return [(i, t, "clash") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "limit"), [(3, 85, neardup.TASK_SHINGLES), (5, 80, neardup.TASK_SHINGLES), (3, 85, 700)])
def test_matches_brute_force(spark, n, percent, limit):
    """The last case has a limit so low that groups are confirmed in blocks."""
    rows = corpus(3, 4, 14)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), n=n, percent=percent, limit=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, n, percent)


def test_copies_nulls_and_empty_tables(spark):
    rows = [(7, "a b c d", "")] * 3 + [(None, "a b c d", ""), (3, "A B C D", ""), (9, None, ""), (9, "", "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == sorted(
        [("7", 3, False)] * 3 + [("None", 3, False), ("3", 3, True), ("9", 9, True), ("9", 9, True)]
    )
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edges_of_copies_are_not_joined_again_in_every_round(spark, monkeypatch):
    """A chain of groups in which everything is linked: most edges end in the first round."""
    names = random.Random(7).sample(range(1_000_000), 400)
    groups = [names[i : i + 20] for i in range(0, 400, 20)]
    edges = [(a, b) for g in groups for i, a in enumerate(g) for b in g[:i]] + [(g[-1], h[0]) for g, h in zip(groups, groups[1:], strict=False)]
    df = spark.createDataFrame(edges, "a long, b long")
    made, join = [], type(df).join

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", counted)
    found = components(df, "a", "b")
    monkeypatch.undo()
    assert {tuple(r) for r in found.collect()} == {(n, min(names)) for n in names}
    assert sum(made) <= 3 * len(edges)
