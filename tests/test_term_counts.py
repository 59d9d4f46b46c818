from collections import Counter

import pytest

from millrace.operators import text

ROWS = [(1, "b a b"), (2, None), (1, "a c"), (None, "x x"), (3, " ,. "), (None, "y"), (4, "Ä9 ä9 _z"), (5, "a " * 40)]


@pytest.mark.parametrize("piece", [1, 7, 500_000])
@pytest.mark.parametrize("batch", ["1", "2", "10000"])
def test_counts_of_keys_over_batches_and_pieces(spark, monkeypatch, piece, batch):
    monkeypatch.setattr(text, "PIECE_WORDS", piece)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(ROWS, "k long, t string")
        found = sorted([tuple(r) for r in text.term_counts(df, "k", "t").collect()], key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {1: "b a b a c", 2: "", None: "x x y", 3: "", 4: "ä9 ä9 z", 5: "a " * 40}
    want = []
    for key, said in words.items():
        counts = Counter(said.split())
        want += [(key, term, n, max(counts.values())) for term, n in counts.items()] or [(key, None, 0, 0)]
    assert found == sorted(want, key=str)


def test_texts_are_shuffled_and_not_their_words(spark):
    df = spark.createDataFrame(ROWS, "k long, t string")
    plan = text.term_counts(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_rare_and_frequent_terms_get_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"all w{i % 3} v{i}") for i in range(30)] + [(99, None)], "k long, t string")
    words = spark.createDataFrame([("all", 1.0), ("w1", -3.0), ("v5", 2.0), ("unsaid", 9.0)], "term string, valence double")
    whole = {r.k: r.compound for r in text.sentiment(docs, "k", "t", words).collect()}
    found = text.semantic_search(docs, "k", "t", "w1 v5 v4", None).collect()
    monkeypatch.setattr(text, "OFTEN", 2)
    assert whole == {r.k: r.compound for r in text.sentiment(docs, "k", "t", words).collect()} and len(whole) == 31
    assert whole[5] == pytest.approx(3 / 24**0.5) and whole[99] == 0
    assert found == text.semantic_search(docs, "k", "t", "w1 v5 v4", None).collect() and len(found) == 11
