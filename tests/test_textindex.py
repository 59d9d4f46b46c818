import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import text, textindex
from millrace.sources import snapshots

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts on topics of their own, with words that all share."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        topic = rng.randrange(30) * 10
        words = [WORDS[topic + rng.randrange(10)] for _ in range(rng.randint(1, 12))] + ["the", "of"] * rng.randint(0, 3)
        rows.append((i, " ".join(rng.sample(words, len(words)))))
    rows += [(900, ""), (901, None), (902, "!!"), (903, "w11 w11"), (904, "w11 w11"), (None, "w299 lone")]
    return spark.createDataFrame(rows, "id long, body string")


def full(docs, question, limit):
    return [tuple(r) for r in text.semantic_search(docs, "id", "body", question, limit).collect()]


def test_loads_and_searches_equal_a_full_scan(spark, docs, tmp_path):
    folder = f"{tmp_path}/index"
    textindex.add(docs.where("id < 500"), "id", "body", folder, job="first", inputs=("docs",))
    textindex.add(docs.where("id >= 500 OR id IS NULL"), "id", "body", folder)
    index = textindex.Index(spark, folder)
    for question, limit in (("w11 w12 the", 5), ("the of", 10), ("w299 unknown", None), ("w11", 2), ("nothing known", 3), ("", 3)):
        assert [tuple(r) for r in index.search(question, limit).collect()] == full(docs, question, limit)
    old = textindex.Index(spark, folder, 1).search("w11 w12", 5).collect()
    assert [tuple(r) for r in old] == full(docs.where("id < 500"), "w11 w12", 5)
    assert snapshots.lineage(spark, folder, "index")[1].count() == 2


def test_replaced_and_removed_texts(spark, docs, tmp_path):
    folder = f"{tmp_path}/index"
    textindex.add(docs, "id", "body", folder)
    changed = docs.where("id % 7 = 0 OR id IS NULL").withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit(" w5 fresh")))
    textindex.add(changed, "id", "body", folder)
    now = docs.join(changed.select(F.col("id").alias("other")), F.col("id").eqNullSafe(F.col("other")), "left_anti").unionByName(changed)
    for question in ("fresh w5", "w11 the"):
        assert [tuple(r) for r in textindex.Index(spark, folder).search(question, 8).collect()] == full(now, question, 8)
    textindex.remove(now.where("id >= 300 OR id IS NULL"), "id", folder)
    assert [tuple(r) for r in textindex.Index(spark, folder).search("w5 fresh", None).collect()] == full(now.where("id < 300"), "w5 fresh", None)


def test_blocks_that_cannot_count_are_not_read(spark, docs, tmp_path):
    folder = f"{tmp_path}/index"
    textindex.add(docs, "id", "body", folder)
    index = textindex.Index(spark, folder)
    _, read, skipped = index.plan("w11 the of", 3)
    assert read and len(skipped) > len(read)
    plan = index._scores({"w11": 1.0}, read)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*\(term,w11\)", plan)


def test_an_index_of_nothing(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        textindex.Index(spark, f"{tmp_path}/none")
    textindex.add(docs.where("id >= 900 AND id < 903"), "id", "body", f"{tmp_path}/empty")
    assert textindex.Index(spark, f"{tmp_path}/empty").search("w1", 3).count() == 0
    textindex.add(docs.where("false"), "id", "body", f"{tmp_path}/empty")
    assert textindex.Index(spark, f"{tmp_path}/empty").search("w1", None).count() == 0


def test_words_of_a_load_are_not_shuffled_one_by_one(spark, docs, tmp_path):
    counts = text.term_lists(docs, "id", "body").withColumnRenamed("id", "key")
    plan = textindex._weighed(counts)[textindex.POSTINGS]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2
    assert {r.key: len(r.words) for r in counts.where("key >= 900").collect()} == {900: 0, 901: 0, 902: 0, 903: 1, 904: 1}


def test_blocks_in_pieces_are_searched_whole(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PIECE_WORDS", 3)
    monkeypatch.setattr(textindex, "PIECE_ROWS", 5)
    textindex.add(docs, "id", "body", f"{tmp_path}/index")
    index = textindex.Index(spark, f"{tmp_path}/index")
    assert index.postings.groupBy("term", "block").count().where("count > 1").count()
    for question, limit in (("w11 w12 the", 5), ("the of", 10), ("w299 unknown", None)):
        assert [tuple(r) for r in index.search(question, limit).collect()] == full(docs, question, limit)


def test_an_index_of_another_layout_is_refused(spark, docs, tmp_path):
    snapshots.publish(spark, f"{tmp_path}/old", None, {"texts": docs.select(F.col("id").alias("key"))})
    with pytest.raises(ValueError, match="layout"):
        textindex.add(docs, "id", "body", f"{tmp_path}/old")
