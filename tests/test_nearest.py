import numpy as np
import pytest

from millrace.operators.nearest import top_k_pruned
from millrace.operators.text import TopK, top_k_similar


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")


def same(spark, queries, corpus, k, **options):
    names = (k, "id", "v", "id", "v")
    want = top_k_similar(queries.where("v IS NOT NULL"), corpus.where("v IS NOT NULL"), *names).orderBy("query_id", "rank").collect()
    got = top_k_pruned(queries, corpus, *names, **options).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [(r.query_id, r["rank"], r.id) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-9)
    return got


def test_clusters_skip_parts(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    vectors = [middles[i % 12] + rng.normal(size=16) * 0.02 for i in range(360)]
    corpus = table(spark, vectors)
    got = same(spark, corpus.where("id % 9 = 0"), corpus, 4, centres=48, corpus_block=20, query_block=7)
    searched = {r.query_id: (r.parts_searched, r.parts) for r in got}
    assert len(searched) == 40 and all(s < p / 2 for s, p in searched.values())


def test_no_clusters_ties_zero_and_unknown_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=4) for _ in range(60)] + [np.zeros(4)] * 3 + [None] * 2 + [np.ones(4)] * 9
    corpus = table(spark, vectors)
    same(spark, corpus, corpus, 6, centres=5, corpus_block=11)
    same(spark, corpus.limit(3), corpus.where("id >= 60 AND id < 63"), 2)
    assert len(same(spark, corpus.limit(3), corpus.where("id < 3"), 50)) == 9


def test_empty_sides_and_unequal_lengths(spark):
    corpus = table(spark, [[1, 0], [0, 1]])
    assert top_k_pruned(corpus, corpus.limit(0), 2, "id", "v", "id", "v").count() == 0
    assert top_k_pruned(corpus.limit(0), corpus, 2, "id", "v", "id", "v").count() == 0
    with pytest.raises(Exception, match="differ in length"):
        top_k_pruned(table(spark, [[1, 0, 0]]), corpus, 2, "id", "v", "id", "v").collect()


def test_a_block_scores_few_rows_and_misses_none():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 16))
    x[1000:1400] = x[17]  # copies
    x[1400:1500] = x[18] * np.linspace(1, 2, 100)[:, None]  # equal directions
    x[1500:1520] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    asked = np.concatenate([x[:40], x[1500:1501]])
    search = TopK(asked, 5)
    for start in range(0, len(x), 1250):
        search.add(x[start : start + 1250], np.arange(start, start + 1250), np.arange(len(asked)))
    query, place, score = search.result()
    plain = np.round(asked @ x.T, 12)
    for i in range(len(asked)):
        want = np.lexsort((np.arange(len(x)), -plain[i]))[:5]
        assert place[query == i].tolist() == want.tolist()
        assert score[query == i] == pytest.approx(plain[i][want], abs=1e-11)
    assert search.scored < 0.05 * asked.shape[0] * len(x)
