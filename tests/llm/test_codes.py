"""Vector codes against plain k-means over integers, and the search against full distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from fleetgauge.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row int"


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), error in zip(kept, errors):
        totals[label] = totals.get(label, 0) + error
    print_ = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), error, totals[label], print_)
                  for (i, _, label), f, error in zip(kept, found, errors))


def found(spark, rows, partitions=3):
    frame = spark.createDataFrame([(i, v, label, "x", 7) for i, v, label in rows], SCHEMA)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)
                  for r in codes.compress(frame.repartition(partitions)).collect())


def vectors(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(12)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(1000 - i, v, rng.choice([0, 1, None])) for i, v in enumerate(vectors(420, 8, 1))]
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1),
             (2003, [float("inf")] + [0.0] * 7, None), (2004, [float("-inf")] * 8, 1)]
    rows += [(3000 + i, [0.25, -0.25] * 4, 5) for i in range(150)]  # repeated vectors tie
    assert found(spark, rows) == plain(rows)


def test_few_vectors_repeated_and_null_ids(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(9, 4, 2))]
    rows += [(3, rows[3][1], None), (None, [0.5] * 4, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(1, [0.0] * 4, None)]) == plain([(1, [0.0] * 4, None)])


def test_vectors_of_other_lengths_have_no_code(spark):
    rows = [(1, [0.5] * 8, 0), (2, [0.25] * 8, 0), (3, [1.0] * 4, 0), (4, [], None)]
    got = found(spark, rows)
    assert got[:2] == plain(rows[:2]) and [r[1:4] for r in got[2:]] == [(None, None, 0), (None, None, None)]
    assert [r[1:4] for r in found(spark, [(1, [0.5] * 6, 0), (2, [0.5] * 8, 0)])] == [(None,) * 3] * 2
    assert [r[1:4] for r in found(spark, [(1, [], 0)])] == [(None,) * 3]


def test_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 0)]) == []


def test_components_beyond_the_bound_are_refused(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        found(spark, [(1, [1e9] * 4, 0)])


@pytest.mark.parametrize("entries,width,spread", [(256, 16, 30), (256, 3, 4000), (70, 5, 1), (1, 4, 10), (64, 2, 2)])
def test_search_finds_the_nearest_and_the_lower_of_equals(entries, width, spread):
    rng = np.random.default_rng(entries + width)
    book = rng.integers(-spread, spread + 1, (entries, width))
    points = np.concatenate([rng.integers(-3 * spread, 3 * spread + 1, (700, width)), book,
                             np.full((2, width), codes.LARGEST)])
    slices = codes.Slices(book)
    best, least = slices.nearest(points)
    gaps = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (best == gaps.argmin(1)).all() and (least == gaps.min(1)).all()
    masks = slices.inside(points.astype(np.int64), np.full(len(points), spread))
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :entries].astype(bool)
    assert (bits == (abs(points[:, None, :] - book[None]) <= spread).all(2)).all()
