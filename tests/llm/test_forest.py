import math
import random

import numpy as np

from millrace.llm import forest

SCHEMA = "vec_id long, embedding array<float>, cls int"


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = scored[:k]
    return out


def vectors(count, dim=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    return [(i, (centres[i % 12] + 0.4 * draw.standard_normal(dim)).astype(np.float32).tolist(), 0) for i in range(count)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in forest.search(df, df.where("vec_id % 10 = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_exact_scores(spark):
    rows = vectors(1500)
    got = found(spark, rows, k=10, least=300, share=0.1, cut_rows=400, cut_queries=40)
    want = brute([(i, v) for i, v, _ in rows], [(i, v) for i, v, _ in rows if i % 10 == 0], 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    distances = {q: dict((i, s) for s, i in brute([(i, v) for i, v, _ in rows], [(q, rows[q][1])], 1500)[q]) for q in list(want)[:5]}
    for q, of in distances.items():
        assert all(math.isclose(s, of[i], rel_tol=1e-12) for s, i in got[q])


def test_ties_copies_and_rows_that_take_no_part(spark):
    draw = random.Random(1)
    same = [1.0, 0.0, 2.0]
    rows = [(i, same, 0) for i in range(0, 60)] + [(100 + i, [draw.random() for _ in range(3)], 0) for i in range(8)]
    rows += [(5, same, 0), (None, same, 0), (200, None, 0), (210, [0.0, 0.0, 0.0], 0), (220, [1.0, None, 1.0], 0), (230, [float("nan"), 1.0, 1.0], 0), (240, [float("inf"), 1.0, 1.0], 0), (250, [1.0], 0)]
    got = found(spark, rows, k=4)
    assert set(got) == {0, 10, 20, 30, 40, 50, 100}
    assert got[0] == [(0.0, i) for i in (1, 2, 3, 4)] and got[50] == [(0.0, i) for i in (0, 1, 2, 3)]
    assert [i for _, i in got[100]] == [i for _, i in brute([(i, v) for i, v, _ in dict.fromkeys((r[0], tuple(r[1]), 0) for r in rows[:68])], [(100, rows[60][1])], 4)[100]]


def test_few_rows_and_none(spark):
    rows = vectors(3)
    assert len(found(spark, rows)[0]) == 2
    assert found(spark, rows[:1]) == {} and found(spark, []) == {}
