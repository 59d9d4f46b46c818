import hashlib
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

WORDS = "[^\x20\x09-\x0d]+"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """The excess over the caps is shared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: float(most * sizes[s]) if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def brute(rows, seed, prefer=lambda size: 1.0):
    """(doc_id, source, size) to words taken, in the order of the draws."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, taken = brute_targets(sizes), []
    for s, size in sizes.items():
        words = math.floor(target[s] + 0.5)
        whole = words // size if size else 0
        rest = words - whole * size
        ranked = []
        for d, _, n in (r for r in rows if r[1] == s):
            u = (int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            key = u / (1 - u) / (rest / (size - rest) * prefer(n)) if rest and n else math.inf
            ranked.append((key, d is None, d or 0, n))
        for _, gone, d, n in sorted(ranked):
            sample = min(max(rest, 0), n)
            rest -= n
            taken.append((None if gone else d, s, n, whole * n + sample))
    return sorted(taken, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "z", "é", None]), rng.choice([0, 1, 3, 40, 900])) for i in range(300)]
    rows += [(None, "a", 5), (None, "a", 5), (7, "b", 11), (7, "b", 11), (900, "tiny", 1), (901, "none", 0)]
    docs = spark.createDataFrame([(d, s, "w " * n, "x", 1) for d, s, n in rows], "doc_id long, source string, text string, size string, taken int").repartition(4)
    for prefer, plain in ((None, lambda n: 1.0), (F.sqrt(F.col("size").cast("double")), math.sqrt)):
        out = mixing.mix(docs, "doc_id", "text", "source", prefer=prefer, seed=seed).select("doc_id", "mix.*")
        got = out.collect()
        assert sorted(((r.doc_id, r.source, r["size"], r.taken) for r in got), key=str) == brute(rows, seed, plain)
        assert all(r.taken == r.copies * r["size"] + r.cut and r.cut < max(r["size"], 1) and r.taken <= 3 * r["size"] for r in got)
        taken, target = {}, {}
        for r in got:
            taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)


def test_targets_share_the_excess_again(spark):
    sizes = {"a": 5, "b": 100, "c": 1, "d": 2, "e": 4000, None: 700, "f": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_more_odds_mean_more_often_and_seeds_differ(spark):
    docs = spark.range(4000).select(F.col("id").alias("k"), F.lit("w x y z").alias("t"), F.concat(F.lit("s"), F.col("id") % 2).alias("s"))
    drawn = {seed: {r.k: r.mix.taken for r in mixing.mix(docs, "k", "t", "s", weights=(1, 1), seed=seed, prefer=F.when(F.col("key") % 3 == 0, 4.0).otherwise(1.0)).collect()} for seed in (1, 2)}
    assert set(drawn[1].values()) == {4}  # equal weights and sizes: every document once
    docs = docs.withColumn("s", F.when(F.col("k") < 1000, "s0").otherwise("s1"))
    drawn = {seed: {r.k: r.mix.taken for r in mixing.mix(docs, "k", "t", "s", weights=(1, 1), seed=seed, prefer=F.when(F.col("key") % 3 == 0, 4.0).otherwise(1.0)).collect()} for seed in (1, 1, 2)}
    rich = [v for k, v in drawn[1].items() if k >= 1000 and k % 3 == 0]
    poor = [v for k, v in drawn[1].items() if k >= 1000 and k % 3]
    assert sum(rich) / len(rich) > 1.3 * sum(poor) / len(poor)
    assert drawn[1] != drawn[2]


def test_empty_tables_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, None, None)], "k long, t string, s string")
    assert [tuple(r.mix) for r in mixing.mix(docs, "k", "t", "s").collect()] == [(None, 0, 0, 0.0, 0, 0, 0)]
    assert mixing.mix(docs.limit(0), "k", "t", "s").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumnRenamed("k", "mix"), "mix", "t", "s")


def test_words_of_all_kinds():
    texts = pa.array(["a b", "", None, " a b\x0bc\t", "日本 語" * 50_000, "x", "y z"])
    assert mixing.count_words(texts).tolist() == [2, 0, 0, 2, 50_001, 1, 2]
    assert mixing.count_words(texts.slice(3, 2)).tolist() == [2, 50_001]
