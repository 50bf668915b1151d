"""Small documents with every awkward case, and plain models of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import types as T

PLAIN = re.compile("[^\x20\x09-\x0D]+")
LEXICAL = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Input columns named like those that operators make.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("mark", T.IntegerType()), T.StructField("row", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("size", T.StringType())])


def frame(spark, rows, partitions: int = 3):
    """Documents from (doc_id, text[, lang, source]); the clashing columns hold noise."""
    full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], len(r[1] or ""), "x", 1, "y", "z", "w")
            for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}é" if rng.random() < 0.1 else f"w{rng.randrange(words)}"
                    for _ in range(n))


def documents(seed: int = 3, very_long: int = 30_000) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empties, ties and a very long text."""
    rng = random.Random(seed)
    passage, base = prose(rng, 40), prose(rng, 120)
    rows = [(10, None), (11, ""), (12, " \t\n\x0b "), (13, "one"), (14, "one two three"),
            (15, "One Two THREE"), (16, "a b c d e"), (17, "a b c d e"), (18, "a " * 70),
            (19, "the the the " * 30), (None, prose(rng, 30)), (20, "###\n$$$ %%%\n###")]
    for i in range(12):  # near copies of one text, each with a few words of its own
        own = base.split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        rows.append((30 + i, " ".join(own)))
    for i in range(10):
        rows.append((50 + i, prose(rng, rng.randrange(5, 60)) + "\n" + passage + "\t" + prose(rng, rng.randrange(30))))
    rows += [(70 + i, rows[12][1]) for i in range(3)]
    rows.append((80, prose(rng, very_long // 2, 10_000) + " " + passage + " " + prose(rng, very_long // 2, 10_000)))
    rows += [(i, prose(rng, rng.randrange(1, 40))) for i in range(100, 130)]
    return rows


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = PLAIN.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def order(doc_id) -> int:
    return -(1 << 63) if doc_id is None else doc_id
