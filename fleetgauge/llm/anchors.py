"""Substring dedup over words with fixed-block anchors.

The index holds the non-overlapping blocks of ``block`` words of every text; half a window
is short enough for every window of ``window`` words to contain a whole block. Every
rolling run of ``block`` words of every text probes the index. A probe that meets a block
of another place is a hit; the windows that contain a hit are extended to ``window`` words
and compared by their whole word sequence, and chains of repeated windows give the maximal
exact repeats. The first occurrence, by document id and then place, stays; every word of a
later one is removed.

Hashes of ``block`` words travel packed, 4 bytes a probe, since a false hit costs only a
comparison. Hashes that decide have 64 bits. Equal texts count as one: the later ones
repeat the first as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import packs, probes, scan
from fleetgauge.llm.tables import partitions, written

WINDOW = 20

_NONE = hashlib.sha256(b"").hexdigest()


def _runs(column):
    """Runs of texts: first row, behind the last, bytes, words' starts, ends, offsets, hashes."""
    table = scan.plain_words()
    raw, offsets = scan.texts(column)
    for a, b in scan.runs(offsets):
        own, bytes_ = offsets[a:b + 1] - offsets[a], raw[offsets[a]:offsets[b]]
        starts, ends, heads = scan.words(bytes_, own, table)
        yield a, b, bytes_, starts, ends, heads, scan.span_hashes(scan.prefix_sums(bytes_), starts, ends)


def _kept(bytes_: np.ndarray, starts, ends, heads, keep: np.ndarray):
    """The kept words of each text, joined by one space: all bytes, and their offsets."""
    text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    at = np.flatnonzero(keep)
    inner = at[:-1][text[at[:-1]] == text[at[1:]]] if len(at) else at
    edge = np.zeros(len(bytes_) + 1, np.int8)
    edge[starts[at]] += 1
    np.subtract.at(edge, ends[at], 1)
    mask = np.cumsum(edge)[:-1] > 0
    out = bytes_.copy()
    out[ends[inner]] = 0x20
    mask[ends[inner]] = True
    sizes = np.bincount(text[at], weights=(ends - starts)[at], minlength=len(heads) - 1) + np.bincount(
        text[inner], minlength=len(heads) - 1)
    return out[mask], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _shas(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _cut(raw: np.ndarray, offsets: np.ndarray, block: int):
    """Every run of ``block`` words of each text, and whether it lies on the block grid."""
    starts, ends, heads = scan.words(raw, offsets, scan.plain_words())
    hashes = scan.span_hashes(scan.prefix_sums(raw), starts, ends)
    first, text = scan.windows_of(heads, block)
    return text, scan.gram_hashes(hashes, block)[first], (first - heads[text]) % block == 0


def _described(texts: DataFrame) -> DataFrame:
    """(mark, n_words, whole_sha256) of every text."""
    def describe(batches):
        for batch in batches:
            for a, b, bytes_, starts, ends, heads, _ in _runs(batch.column(1)):
                shas = _shas(*_kept(bytes_, starts, ends, heads, np.ones(len(starts), bool)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(heads).astype(np.int64)),
                     pa.array(shas, pa.string())], names=["mark", "n_words", "whole_sha256"])

    return texts.select("mark", "text").mapInArrow(
        describe, "mark long, n_words long, whole_sha256 string")


def _windows(met: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    """Windows that contain a hit, by part of their hash: ids, marks, hashes and places."""
    def extend(batches):
        for batch in batches:
            bits = batch.column(3).to_pylist()
            for a, b, _, _, _, heads, hashes in _runs(batch.column(2)):
                first, text = scan.windows_of(heads, block)
                grams = scan.gram_hashes(hashes, block)[first]
                hit = np.zeros(len(hashes) + 1, np.int64)
                hit[first] = probes.met_flags(text, grams, parts, bits[a:b])
                sums = np.concatenate([[0], np.cumsum(hit)])
                start, text = scan.windows_of(heads, window)
                wanted = sums[start + window - block + 1] > sums[start]
                start, text = start[wanted], text[wanted]
                whole = scan.gram_hashes(hashes, window)[start]
                ids = batch.column(0).slice(a, b - a).fill_null(-(1 << 63)).to_numpy()
                marks = batch.column(1).slice(a, b - a).to_numpy()
                used, columns = packs.dealt((whole % np.uint64(parts)).astype(np.int64), parts, ids[text],
                                            marks[text], whole, (start - heads[text]).astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [used, *columns], names=["part", "ids", "marks", "hashes", "places"])

    return met.select("id", "mark", "text", "bits").mapInArrow(
        extend, "part int, ids binary, marks binary, hashes binary, places binary")


def _later(windows: DataFrame, parts: int) -> DataFrame:
    """(mark, places): the windows of each text that start earlier somewhere else."""
    def judge(table):
        ids, marks = packs.unpacked(table.column("ids"), np.int64), packs.unpacked(table.column("marks"), np.int64)
        hashes, place = packs.unpacked(table.column("hashes"), np.uint64), packs.unpacked(table.column("places"), np.uint32)
        order = np.lexsort((place, marks, ids, hashes))
        later = np.ones(len(order), bool)
        later[order[packs.heads(hashes[order])]] = False
        marks, place = marks[later], place[later]
        used, columns = packs.dealt((marks.view(np.uint64) % np.uint64(parts)).astype(np.int64), parts, marks, place)
        return pa.Table.from_arrays([used, *columns], names=["part", "marks", "places"])

    def gather(table):
        marks, place = packs.unpacked(table.column("marks"), np.int64), packs.unpacked(table.column("places"), np.uint32)
        order = np.lexsort((place, marks))
        marks, place = marks[order], place[order]
        head = packs.heads(marks)
        return pa.table({"mark": pa.array(marks[head]),
                         "places": packs.binaries(place, np.append(head, len(marks)))})

    found = windows.groupBy("part").applyInArrow(judge, "part int, marks binary, places binary")
    return found.groupBy("part").applyInArrow(gather, "mark long, places binary")


def _removed(texts: DataFrame, window: int) -> DataFrame:
    """(mark, n_removed, kept_sha256, spans) of texts with later windows."""
    def remove(batches):
        for batch in batches:
            places = batch.column(2).to_pylist()
            for a, b, bytes_, starts, ends, heads, _ in _runs(batch.column(1)):
                at = np.concatenate([heads[i] + np.frombuffer(places[a + i], np.uint32).astype(np.int64)
                                     for i in range(b - a)])
                cover = np.bincount(at, minlength=len(starts) + 1) - np.bincount(
                    at + window, minlength=len(starts) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                text = np.repeat(np.arange(b - a), np.diff(heads))
                first, last = packs.spans_of(gone, text)
                base = heads[text[first]]
                owners = np.searchsorted(text[first], np.arange(b - a + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(owners), pa.StructArray.from_arrays(
                    [pa.array(first - base), pa.array(last - base)], names=["first", "last"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(np.bincount(text[gone], minlength=b - a).astype(np.int64)),
                     pa.array(_shas(*_kept(bytes_, starts, ends, heads, ~gone)), pa.string()), spans],
                    names=["mark", "n_removed", "kept", "spans"])

    return texts.select("mark", "text", "places").mapInArrow(
        remove, "mark long, n_removed long, kept string, spans array<struct<first: long, last: long>>")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
            window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans, kept_sha256.

    ``spans`` are the removed stretches as (first, last) word numbers, last exclusive;
    ``kept_sha256`` hashes the other words, joined by one space. Ids are integers; the null
    id is the least. Documents of one id count as earlier or later by a hash of their text,
    and rows equal in id and text are judged alike. Null texts have no words. A text of
    fewer words than ``window`` keeps all. No rows give no rows; other columns are not read.
    """
    parts, block = partitions(docs.sparkSession), window // 2
    every, first, texts = probes.originals(probes.numbered(docs, key, text))
    met = written(probes.met(texts, lambda raw, offsets: _cut(raw, offsets, block), parts), "anchor-hits")
    later = written(_later(_windows(probes.with_texts(texts, met), block, window, parts), parts),
                    "later-windows")
    gone = written(_removed(probes.with_texts(texts, later), window), "removed")
    whole = written(_described(texts).join(gone, "mark", "left").join(first, "mark"), "judged")
    copy = ~F.col("id").eqNullSafe(F.col("first_id"))
    cut = F.col("n_words") >= window
    none = F.expr("cast(array() as array<struct<first: long, last: long>>)")
    return every.join(whole, "mark").select(
        "id", "n_words",
        F.when(~copy, F.coalesce("n_removed", F.lit(0))).when(cut, F.col("n_words")).otherwise(0)
        .cast("long").alias("n_removed"),
        F.when(~copy, F.coalesce("spans", none))
        .when(cut, F.expr("array(named_struct('first', 0L, 'last', n_words))")).otherwise(none).alias("spans"),
        F.when(~copy, F.coalesce("kept", "whole_sha256")).when(cut, F.lit(_NONE))
        .otherwise(F.col("whole_sha256")).alias("kept_sha256"))
