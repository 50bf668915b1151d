"""Substring dedup over words and over bytes against plain versions."""

import random

import numpy as np
import pytest

from fleetgauge.llm import anchors, suffixes
from tests.llm import cases


def by_words(rows, window=20):
    order = sorted(range(len(rows)), key=lambda i: cases.order(rows[i][0]))
    seen, out = {}, []
    texts = [cases.PLAIN.findall(r[1] or "") for r in rows]
    for i in order:
        for p in range(len(texts[i]) - window + 1):
            seen.setdefault(tuple(texts[i][p:p + window]), (i, p))
    for i, w in enumerate(texts):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p:p + window])] != (i, p):
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(rows[i][0]), len(w), sum(gone), cases.sha(kept.encode())))
    return sorted(out)


def by_bytes(rows, window=50):
    data = [(r[1] or "").encode() for r in rows]
    least, out = {}, []
    for r, d in zip(rows, data):
        for p in range(len(d) - window + 1):
            least[d[p:p + window]] = min(least.get(d[p:p + window], 1 << 62), cases.order(r[0]))
    for r, d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - window + 1):
            if least[d[p:p + window]] < cases.order(r[0]):
                gone[p:p + window] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((str(r[0]), len(d), int(gone.sum()), spans,
                    cases.sha(bytes(b for b, g in zip(d, gone) if not g))))
    return sorted(out)


def words_got(frame):
    return sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def bytes_got(frame):
    return sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("seed", [3, 8])
def test_awkward_documents(spark, seed):
    rows = cases.documents(seed, very_long=4000)
    frame = cases.frame(spark, rows)
    assert words_got(anchors.repeats(frame)) == by_words(rows)
    assert bytes_got(suffixes.repeats(frame)) == by_bytes(rows)


def test_spans_are_what_was_removed(spark):
    rows = cases.documents(4, very_long=1000)
    for r in anchors.repeats(cases.frame(spark, rows)).collect():
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        assert all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_within_one_document(spark):
    rng = random.Random(6)
    part = cases.prose(rng, 25)
    rows = [(7, f"{part} {part} x {part}"), (9, "a " * 100), (8, part.replace(" ", "\n\n"))]
    assert words_got(anchors.repeats(cases.frame(spark, rows))) == by_words(rows)
    assert bytes_got(suffixes.repeats(cases.frame(spark, rows))) == by_bytes(rows)


def test_empty_and_repeated_rows(spark):
    for operator in (anchors.repeats, suffixes.repeats):
        assert operator(cases.frame(spark, [])).count() == 0
        text = cases.prose(random.Random(1), 30)
        # Rows equal in id and text are judged alike: as the first they are.
        found = operator(cases.frame(spark, [(1, text), (1, text), (2, text), (None, None)])).collect()
        assert sorted((r.id or 0, r.n_removed > 0) for r in found) == [
            (0, False), (1, False), (1, False), (2, True)]


def test_collection_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(120):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
                 for _ in range(rng.randint(1, 8))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        _, prefix, owner, length = suffixes.collection(data, offsets, 100)
        plain = sorted((t[len(t) - n:], i, n) for i, t in enumerate(texts) for n in range(len(t) + 1))
        assert [(i, n) for _, i, n in plain] == list(zip(owner.tolist(), length.tolist()))
        for at in range(1, len(plain)):
            x, y = plain[at - 1][0], plain[at][0]
            assert prefix[at] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]),
                                      min(len(x), len(y)))
