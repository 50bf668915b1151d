"""Alignment of the tokens that two tokenizers give the same text.

Both token sequences are laid over the bytes of a space and the text. An as-of merge keyed by
document gives, for the start of each token, the other side's token that covers it; the union
of both directions is every pair of tokens that share a byte, since of two overlapping tokens
the later start lies inside the other. Bytes where tokens of both sides end cut the text into
groups, the least stretches that both sides spell with whole tokens.

How many documents link two ids is counted over the whole corpus. Most links belong to few id
pairs, so the pairs of the most documents, a bounded number, are broadcast to the documents;
links of all other pairs meet their counts in a join by pair.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm import pretokens, scan
from fleetgauge.llm.tables import written

#: The second tokenizer puts a space before the text, so both sides spell this and the text.
LEAD = b" "
#: The mark that stands for a space inside the second tokenizer's pieces.
SPACE_MARK = "▁"
#: Id pairs that are broadcast with their counts, at most.
HOT_PAIRS = 1_000_000
#: Words of each side that a worker remembers, and tokens of them: rare words come back late.
WORDS, TOKENS = 600_000, 4_000_000


def load_pieces(path: str) -> SimpleNamespace:
    """A piece model's file, read on the driver, and the bytes of its pieces.

    ``by_word`` is proved here: where characters are kept as they are, unknown ones fall back
    to bytes, and no piece has the space mark behind another character, merges never cross the
    border before a word's spaces, so that words can be encoded alone.
    """
    import sentencepiece

    with open(path, "rb") as file:
        model = file.read()
    known = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    in_bytes = [known.is_byte(i) for i in range(len(names))]
    table = [bytes([int(name[3:5], 16)]) if byte else name.replace(SPACE_MARK, " ").encode()
             for name, byte in zip(names, in_bytes)]
    probe = "  ﬁ Ａ e\u0301\t \u00a0x\u2003 \n  "
    kept = b"".join(table[i] for i in known.encode(probe)) == LEAD + probe.encode()
    by_word = (kept and sum(in_bytes) == 256 and SPACE_MARK in names
               and not any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names))
    return SimpleNamespace(model=model, table=table, by_word=by_word, words=None)


def _pieces(shared: SimpleNamespace) -> Pieces:
    if shared.words is None:
        shared.words = Pieces(shared)
    return shared.words


class Pieces(pretokens.Memory):
    """Words with the spaces before them, as the piece model encodes them.

    Every word begins with a space: the text's first one with the space put before the text.
    """

    def __init__(self, shared: SimpleNamespace):
        import sentencepiece

        super().__init__({}, {}, shared.table)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=shared.model)
        self.space = self.model.piece_to_id(SPACE_MARK)
        self.cut = re.compile(" *[^ ]+| +" if shared.by_word else "(?s).+")

    def merge(self, new: list[str]) -> list[list[int]]:
        # The model puts the first space itself, but not before nothing.
        ids = self.model.encode([w[1:] for w in new], out_type=int, num_threads=1)
        return [x if len(w) > 1 else [self.space] for w, x in zip(new, ids)]

    def pieces(self, text: str):
        yield self.cut.findall(text)


class Side:
    """Tokens of one tokenizer over the bytes of a run of texts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
        self.ids, self.counts = ids, counts
        self.ends = np.cumsum(lengths[ids])
        self.starts = self.ends - lengths[ids]
        self.doc = np.repeat(np.arange(len(counts)), counts)


def _covering(side: Side, other: Side) -> np.ndarray:
    """For each token, the other side's token that covers its start.

    Documents lie one after another, each with a place of its own behind its bytes, so the
    place names the document too: the merge needs no second key and never leaves a document.
    """
    left = pd.DataFrame({"at": side.starts + side.doc})
    right = pd.DataFrame({"at": other.starts + other.doc, "token": np.arange(len(other.ids))})
    return pd.merge_asof(left, right, on="at")["token"].to_numpy(np.int64)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that share a byte, as places on both sides."""
    of_a, of_b = _covering(a, b), _covering(b, a)
    later = b.starts != a.starts[of_b]  # equal starts were found from the other side
    return (np.concatenate([np.arange(len(a.ids)), of_b[later]]),
            np.concatenate([of_a, np.flatnonzero(later)]))


def _groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end where the other side has an end too."""
    place = np.searchsorted(b.ends, a.ends)
    cut_a = b.ends[np.minimum(place, max(len(b.ends) - 1, 0))] == a.ends if len(b.ends) else np.zeros(0, bool)
    cut_b = np.zeros(len(b.ends), bool)
    cut_b[place[cut_a]] = True
    return cut_a, cut_b


def _spelled(a: Side, b: Side, cut_a, cut_b, names: np.ndarray, size_a: int, size_b: int):
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    until_a = np.flatnonzero(cut_a) + 1  # tokens up to the end of each group
    before_b = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
    out = np.empty(len(a.ids) + len(b.ids), np.int64)
    # names holds: ids of A before "," and "|", ids of B before ",", ";" and an end.
    out[np.arange(len(a.ids)) + before_b[group_a]] = a.ids + size_a * cut_a
    last = np.zeros(len(b.ids), bool)
    last[np.cumsum(b.counts)[b.counts > 0] - 1] = True
    out[np.arange(len(b.ids)) + until_a[group_b]] = 2 * size_a + b.ids + size_b * (cut_b + last.astype(int))
    parts = names[out]
    edges = np.concatenate([[0], np.cumsum(a.counts + b.counts)])
    return ["".join(parts[x:y]) for x, y in zip(edges[:-1], edges[1:])]


def _names(size_a: int, size_b: int) -> np.ndarray:
    return np.array([f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, (",", ";", "")))
                     for mark in marks for i in range(size)], dtype=object)


def _only(ids, offsets, keep):
    """The ids of the kept texts, and the token count of each text, 0 for the others."""
    counts = np.diff(offsets)
    return ids[np.repeat(keep, counts)], np.where(keep, counts, 0)


def align(docs: DataFrame, byte_bpe: str, pieces: str, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of ``docs``.

    Side A is the byte-level tokenizer file ``byte_bpe`` over a space and the text, side B the
    piece model ``pieces`` over the text, before which it puts the space. ``groups`` is spelled
    ``a1,a2|b1;a3|b2,b3`` in decimal ids. ``pairs`` holds the distinct overlapping id pairs as
    A id times B's vocabulary size plus B id, ascending, ``times`` how often each overlaps.

    A null or empty text has no tokens, as has one that either side does not spell byte by
    byte. Texts are taken whole, however long; special strings in them are plain text. Repeated
    rows stay rows of their own, ``row`` tells them apart; an id may be null, an empty table
    gives no rows, and other columns are not read.
    """
    spark = docs.sparkSession
    known = pretokens.load(byte_bpe, specials=False), load_pieces(pieces)
    side_a, side_b = (spark.sparkContext.broadcast(x) for x in known)
    size_a, size_b = len(known[0].table), len(known[1].table)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", docs.schema[key].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(texts, encoders, lengths, names):
        wanted = [LEAD.decode() + t if t else "" for t in texts]
        found = [encoder.encode(wanted) for encoder in encoders]
        keep = np.fromiter(map(bool, wanted), bool, len(wanted)) & found[0][2] & found[1][2]
        a, b = (Side(*_only(ids, offsets, keep), length)
                for (ids, offsets, _), length in zip(found, lengths))
        cut_a, cut_b = _groups(a, b)
        left, right = overlaps(a, b)
        pair = a.ids[left].astype(np.int64) * size_b + b.ids[right]
        # One sort of document and pair in one number.
        whole = size_a * size_b
        both, times = np.unique(a.doc[left] * whole + pair, return_counts=True)
        rows = len(texts)
        of_doc = np.searchsorted(both, np.arange(rows + 1) * whole).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.counts), pa.array(b.counts),
             pa.array(np.bincount(a.doc[cut_a], minlength=rows)), pa.array(np.bincount(a.doc[left], minlength=rows)),
             pa.array(_spelled(a, b, cut_a, cut_b, names, size_a, size_b), pa.string()),
             pa.ListArray.from_arrays(of_doc, pa.array(both % whole)),
             pa.ListArray.from_arrays(of_doc, pa.array(times.astype(np.int32)))], names=schema.names[2:])

    def judge(batches):
        encoders = pretokens.words(side_a.value), _pieces(side_b.value)
        lengths = [np.array([len(x) for x in encoder.table], np.int64) for encoder in encoders]
        names = _names(size_a, size_b)
        for batch in batches:
            _, offsets = scan.texts(batch.column(2))
            for first, last in scan.runs(offsets):
                found = run(batch.column(2)[first:last].to_pylist(), encoders, lengths, names)
                for encoder in encoders:
                    encoder.make_room(WORDS, TOKENS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(1)[first:last], *found.columns],
                    names=schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                       F.col(text).alias("text")).mapInArrow(judge, schema)


def pair_counts(aligned: DataFrame, second: int) -> DataFrame:
    """(pair, documents, best): in how many documents each id pair is linked, and whether no
    pair of the same A id is in more. ``second`` is B's vocabulary size."""
    counted = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("documents")), "pair-counts")
    of_a = F.floor(F.col("pair") / second).cast("long")
    best = counted.groupBy(of_a.alias("a")).agg(F.max("documents").alias("most"))
    # One row per id of A's vocabulary: bounded by the file.
    return written(counted.withColumn("a", of_a).join(F.broadcast(best), "a").select(
        "pair", "documents", (F.col("documents") == F.col("most")).alias("best")), "best-pairs")


def _hot_limit(counts: DataFrame, hot_pairs: int) -> int | None:
    """The least power of two so that at most ``hot_pairs`` pairs are in as many documents or
    more; None where all pairs are few enough. At most 64 rows come to the driver."""
    by_size = dict(counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("k")).count().collect())
    if sum(by_size.values()) <= hot_pairs:
        return None
    taken = 0
    for k in range(max(by_size), -1, -1):
        taken += by_size.get(k, 0)
        if taken > hot_pairs:
            return 1 << (k + 1)
    return 1


def score(aligned: DataFrame, second: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The (written) alignment's rows with n_best, the links whose pair is in the most documents
    of all pairs of their A id, and count_sum, the documents of their pairs summed over links."""
    counts = pair_counts(aligned, second)
    limit = _hot_limit(counts, hot_pairs)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))

    def sums(found: DataFrame) -> DataFrame:
        def total(value: Column, name: str) -> Column:
            return F.sum(value).alias(name)

        return found.groupBy("row").agg(
            total(F.when(F.col("best"), F.col("times")).otherwise(0), "n_best"),
            total(F.col("times") * F.col("documents"), "count_sum"))

    if limit is None:
        scored = sums(links.join(F.broadcast(counts), "pair"))
    else:
        hot = F.broadcast(counts.filter(F.col("documents") >= limit))
        tail = counts.filter(F.col("documents") < limit)
        rare = links.join(hot.select("pair"), "pair", "left_anti")
        scored = (sums(links.join(hot, "pair")).unionByName(sums(rare.join(tail, "pair")))
                  .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return aligned.drop("pairs", "times").join(scored, "row", "left").fillna(0, ["n_best", "count_sum"])
