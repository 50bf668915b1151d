"""Jaccard join, its trees and components against plain versions."""

import random

import numpy as np
import pytest

from fleetgauge.llm import jaccard
from fleetgauge.llm.components import components
from tests.llm import cases


def expected(rows):
    sets = [cases.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and shared and 100 * shared >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted((str(r[0]), len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


def got(frame):
    return sorted((str(r.id), r.n_shingles, r.component_id) for r in frame.collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_components_of_awkward_documents(spark, seed):
    rows = cases.documents(seed, very_long=4000)
    assert got(jaccard.join(cases.frame(spark, rows))) == expected(rows)


def test_near_copies_beyond_the_centre(spark, monkeypatch):
    """Chains, groups of several blocks and trees without centre rounds give the same links."""
    monkeypatch.setattr(jaccard, "CENTRE_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(5)
    words = cases.prose(rng, 100, 5000).split()
    rows = []
    for i in range(40):  # each differs a little from the one before
        rows.append((1000 - i, " ".join(words)))
        for k in range(2):
            words[(7 * i + k) % 100] = f"n{rng.randrange(10_000)}"
    assert got(jaccard.join(cases.frame(spark, rows))) == expected(rows)


def test_empty_and_repeated_rows(spark):
    assert jaccard.join(cases.frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    assert got(jaccard.join(cases.frame(spark, rows))) == sorted(
        [("1", 2, 1), ("1", 2, 1), ("None", 2, 1), ("None", 0, None)])


def test_copies_name_all_but_the_first(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "q"), (None, "a b c d e f"), (4, None), (6, None)]
    found = jaccard.join(cases.frame(spark, rows))
    assert sorted(str(r.id) for r in jaccard.copies(found).collect()) == ["5", "None"]


def test_bound_of_nodes_never_rules_out_a_link():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = np.array(rng.sample(range(10_000), n), np.uint64)
        b = np.concatenate([a[:max(1, int(n * rng.uniform(.7, 1)))],
                            np.array(rng.sample(range(10_000, 20_000), rng.randrange(0, 1 + n // 4)), np.uint64)])
        shared = len(set(a.tolist()) & set(b.tolist()))
        linked = 100 * shared >= 80 * (len(a) + len(b) - shared)
        n = np.array([len(a), len(b)])
        x, y = (jaccard._tree(jaccard._local_bitmaps([a, b]), n, i, i + 1) for i in (0, 1))
        assert linked == jaccard._possible(x, y, 80)
        c = np.array(rng.sample(range(30_000), 40), np.uint64)
        order = sorted([a, b, c], key=len)
        n = np.array([len(s) for s in order])
        root = jaccard._tree(jaccard._local_bitmaps(order), n, 0, 3)
        assert not linked or jaccard._possible(root, root, 80)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 700)]
    random.Random(2).shuffle(edges)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, 400: 400, 500: 400, 700: 400}
