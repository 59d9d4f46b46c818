import hashlib
import math

import numpy as np
import pytest

from millrace.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, vector string"


def brute(rows, rounds=6, entries=16, parts=8):
    good = [(i, [math.floor(4096 * np.float64(x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0))
    length = len(good[0][1])
    good = [r for r in good if len(r[1]) == length]
    width = -(-length // parts)
    good = [(i, v + [0] * (parts * width - length), y) for i, v, y in good]
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(v, p) for _, v, _ in good[:entries]] for p in range(parts)]

    def find(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(piece(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in good:
            for p in range(parts):
                groups.setdefault((p, find(v, p)[1]), []).append(piece(v, p))
        for (p, k), own in groups.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, sums = [], {}
    for i, v, y in good:
        found = [find(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[y] = sums.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=str)


def run(spark, rows, schema=SCHEMA):
    full = [(*r, "x", 1, "y")[: schema.count(",") + 1] for r in rows]
    df = spark.createDataFrame(full, schema).repartition(3)
    got = codes.compress(df, "vec_id", "embedding", "label").collect()
    return sorted(((r.key, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str)


@pytest.mark.parametrize(("scale", "length"), [(0.3, 16), (300.0, 16), (60_000.0, 12)])
def test_against_brute_force(spark, scale, length):
    rng = np.random.default_rng(length)
    rows = [(int(i) * 3, [float(np.float32(x)) for x in rng.normal(0, scale, length)], int(i) % 3 if i % 5 else None) for i in rng.permutation(120)]
    rows += rows[:2] + [(1, None, 1), (2, [float("nan")] * length, 1), (-5, [float("inf")] * length, 0), (4, [None] * length, 2), (5, [0.0] * length, 2), (200_000, [1.0], 2)]
    rows += [(None, [0.25] * length, 7)]
    assert run(spark, rows) == brute(rows)


def test_ties_few_rows_and_empty_tables(spark):
    rows = [(i, [1.0] * 8, 1) for i in range(3)] + [(9, [-1.0] * 8, 1)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[1] for r in got} == {"00" * 8, "03" * 8}
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert codes.compress(df, "vec_id", "embedding", "label").count() == 0
    assert codes.compress(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_vectors_without_components_and_huge_ones(spark):
    assert run(spark, [(1, [], 1), (2, [], None)])[0][1:3] == ("00" * 8, 0)
    rows = [(i, [float(i) * 1e20] + [0.5] * 7, 1) for i in range(20)]
    got = run(spark, rows, "vec_id long, embedding array<double>, label int")
    assert [r[0] for r in got] and all(r[2] is None or r[2] == 0 for r in got)


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(3)
    for bits in (5, 20, 24, 25, 29):
        left, right = (rng.integers(-(1 << bits), 1 << bits, (2, n, 8)) for n in (50, 16))
        left[0, 0], right[0, 0] = -(1 << bits), -(1 << bits)
        want = (left.astype(object)[:, :, None] * right.astype(object)[:, None]).sum(axis=-1)
        assert (codes.dot(left, right) == want).all()
        index, distance = codes.nearest(left, right)
        step = left.astype(object)[:, :, None] - right.astype(object)[:, None]
        full = (step * step).sum(axis=-1)
        assert (index == full.argmin(axis=-1)).all() and (distance == full.min(axis=-1)).all()
        for limb in codes.limbs(left, 10):
            assert (np.abs(limb) <= 1 << 10).all()
