"""Substring dedup over bytes with column-wise construction of collection suffix orders.

Every ``window``-byte string of a text is put into a segment by its least ``gram``-byte
hash, so that equal strings lie, at the same place, in segments of the same gram. Segments
whose gram occurs nowhere else cannot hold a repeat and go no further. The others meet by
gram. There, collections of segments get their Burrows-Wheeler transform and common
prefixes column by column: each round puts one more symbol in front of every segment's
suffix, finds the places of the new suffixes by counting symbols in the transform so far,
and rewrites transform and prefix lengths in one sequential pass. Neighbours with a
common prefix of ``window`` bytes are occurrences of one string.

Collections are independent, so each is built from a bounded run of segments (one gram is
never split), and the two byte arrays that a round rewrites stay in memory instead of files.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import packs, probes, scan
from fleetgauge.llm.tables import partitions, written

WINDOW = 50
GRAM = 24
#: A collection takes segments of about so many bytes.
COLLECTION_BYTES = 1 << 20
#: Marks a finished segment in the transform; no UTF-8 text has this byte.
_END = 0xFF
_NO_ID = -(1 << 63)
_NONE = hashlib.sha256(b"").hexdigest()


def segments(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(texts, gram hashes, starts, lengths in bytes, prefix sums) of the segments of a run.

    A segment spans all windows, one after another, that have their least gram at one place.
    """
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    sums = scan.prefix_sums(raw)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, sums
    hashes = scan.gram_spans(sums, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | places
    width, size = window - gram + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(
        [[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    many = np.diff(np.append(head, len(text)))
    return text[head], hashes[place[head]], first[head], many + window - 1, sums


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last], ends included, for many ranges at once."""
    levels = [values]
    length = last - first + 1
    while (1 << len(levels)) <= int(length.max(initial=1)):
        half, below = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(below[:-half], below[half:]))
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in range(len(levels)):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << k) + 1])
    return out


def collection(data: np.ndarray, offsets: np.ndarray, window: int):
    """(transform, common prefixes up to ``window``, segment and length of each suffix).

    Ends of segments are less than any byte and ordered by segment. Round j inserts the
    suffixes of length j: the one whose predecessor symbol stands at place p goes to the
    number of segments, plus the symbols less than it, plus its equals before p. Its common
    prefix with the suffix above it is one more than the least between the places of the
    two symbols, and so for the suffix below.
    """
    many, lengths = len(offsets) - 1, np.diff(offsets)
    transform = data[offsets[1:] - 1].copy()
    prefix = np.zeros(many, np.uint8)
    active, place = np.arange(many), np.arange(many)
    size = 0
    while len(active):
        size += 1
        order = np.argsort(transform, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        symbols = len(order) - int((transform == _END).sum())
        at = rank[place].astype(np.int64)
        symbol = transform[place]
        above = order[np.maximum(at - 1, 0)]
        has_above = (at > 0) & (transform[above] == symbol)
        below = order[np.minimum(at + 1, len(order) - 1)]
        has_below = (at + 1 < symbols) & (transform[below] == symbol)
        up = np.zeros(len(at), np.uint8)
        up[has_above] = np.minimum(_range_least(
            prefix, above[has_above] + 1, place[has_above]), window - 1) + 1
        down = np.minimum(_range_least(prefix, place[has_below] + 1, below[has_below]), window - 1) + 1
        fresh = np.zeros(many + symbols, bool)
        new = many + at
        fresh[new] = True
        old = ~fresh
        grown, longer = np.empty(many + symbols, np.uint8), np.empty(many + symbols, np.uint8)
        grown[old], longer[old] = transform, prefix
        longer[new] = up
        longer[new[has_below] + 1] = down
        more = lengths[active] > size
        following = np.full(len(active), _END, np.uint8)
        following[more] = data[offsets[active[more] + 1] - size - 1]
        grown[new] = following
        transform, prefix = grown, longer
        active, place = active[more], new[more]
    # Walk from the ends forward through the finished transform to name every suffix.
    order = np.argsort(transform, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    walk, who = np.arange(many), np.arange(many)
    owner[:many] = who
    for j in range(1, size + 1):
        on = lengths[who] >= j
        who, walk = who[on], many + rank[walk[on]]
        owner[walk], length[walk] = who, j
    return transform, prefix, owner, length


def _earliest(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, window: int):
    """(segment, offset) of every window that a segment with a smaller id has as well."""
    _, prefix, owner, length = collection(data, offsets, window)
    whole = np.flatnonzero(length >= window)
    group = np.cumsum(prefix < window)[whole]
    head = packs.heads(group)
    least = np.minimum.reduceat(ids[owner[whole]], head)
    covered = np.repeat(least, np.diff(np.append(head, len(whole)))) < ids[owner[whole]]
    who = owner[whole][covered]
    return who, np.diff(offsets)[who] - length[whole][covered]


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all bytes of the slices, one slice after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _routed(met: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """Segments whose gram occurs elsewhere, with their bytes, by part of the gram's hash."""
    def route(batches):
        for batch in batches:
            bits = batch.column(3).to_pylist()
            raw, offsets = scan.texts(batch.column(2))
            for a, b in scan.runs(offsets):
                bytes_, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                text, hashes, start, size, _ = segments(bytes_, own, window, gram)
                hit = np.flatnonzero(probes.met_flags(text, hashes, parts, bits[a:b]))
                part = (hashes[hit] % np.uint64(parts)).astype(np.int64)
                hit = hit[np.argsort(part, kind="stable")]
                part = (hashes[hit] % np.uint64(parts)).astype(np.int64)
                text, hashes, start, size = text[hit], hashes[hit], start[hit], size[hit]
                ids = batch.column(0).slice(a, b - a).fill_null(_NO_ID).to_numpy()
                marks = batch.column(1).slice(a, b - a).to_numpy()
                used, columns = packs.dealt(part, parts, (hashes // np.uint64(parts)).astype(np.uint32),
                                            ids[text], marks[text], (start - own[text]).astype(np.uint32),
                                            size.astype(np.uint8))
                data = bytes_[_slices(start, size)]
                ends = np.concatenate([[0], np.cumsum(size)])
                edges = ends[np.searchsorted(part, np.append(used.to_numpy(), parts))]
                yield pa.RecordBatch.from_arrays(
                    [used, *columns, packs.binaries(data, edges)],
                    names=["part", "tokens", "ids", "marks", "starts", "sizes", "data"])

    return met.select("id", "mark", "text", "bits").mapInArrow(
        route, "part int, tokens binary, ids binary, marks binary, starts binary, sizes binary, data binary")


def _covered(routed: DataFrame, window: int, parts: int) -> DataFrame:
    """(mark, firsts, lasts): stretches of each text that documents with smaller ids have."""
    def cover(table):
        token = packs.unpacked(table.column("tokens"), np.uint32)
        ids, marks = packs.unpacked(table.column("ids"), np.int64), packs.unpacked(table.column("marks"), np.int64)
        start = packs.unpacked(table.column("starts"), np.uint32).astype(np.int64)
        size = packs.unpacked(table.column("sizes"), np.uint8).astype(np.int64)
        data = packs.unpacked(table.column("data"), np.uint8)
        ends = np.cumsum(size)
        content = np.empty(len(size), np.uint64)
        for a, b in scan.runs(np.concatenate([[0], ends])):
            low, own = ends[a] - size[a], np.concatenate([[0], ends[a:b]]) - (ends[a] - size[a])
            own[0] = 0
            content[a:b] = scan.span_hashes(scan.prefix_sums(data[low:ends[b - 1]]), own[:-1], own[1:])
        order = np.lexsort((ids, content, token))
        # Equal segments are one class; the first of it has the least id.
        new = np.ones(len(order), bool)
        new[1:] = (token[order][1:] != token[order][:-1]) | (content[order][1:] != content[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        least = ids[first]
        again = np.flatnonzero(ids > least[of])
        marks_out, firsts, lasts = [marks[again]], [start[again]], [(start + size)[again]]
        # Grams with several classes: a window may lie in segments that differ around it.
        kinds = np.bincount(np.unique(token[first], return_inverse=True)[1])
        several = np.flatnonzero(np.repeat(kinds, kinds) > 1)
        edges = np.append(packs.heads(token[first][several]), len(several))
        sums = np.concatenate([[0], np.cumsum(size[first][several])])
        own = np.flatnonzero(ids == least[of])
        own = own[np.argsort(of[own], kind="stable")]
        begins = np.searchsorted(of[own], np.arange(len(first) + 1))
        a = 0
        while a < len(edges) - 1:
            b = int(np.searchsorted(sums[edges], sums[edges[a]] + COLLECTION_BYTES, side="right")) - 1
            b = min(max(b, a + 1), len(edges) - 1)
            classes = several[edges[a]:edges[b]]
            sizes = size[first[classes]]
            who, at = _earliest(data[_slices(ends[first[classes]] - sizes, sizes)],
                                np.concatenate([[0], np.cumsum(sizes)]), least[classes], window)
            # To every occurrence of the class under its least id; others are covered above.
            found = classes[who]
            times = begins[found + 1] - begins[found]
            mine = own[_slices(begins[found], times)]
            marks_out.append(marks[mine])
            firsts.append(start[mine] + np.repeat(at, times))
            lasts.append(start[mine] + np.repeat(at, times) + window)
            a = b
        marks, first_, last_ = map(np.concatenate, (marks_out, firsts, lasts))
        # Stretches of a text that touch are one already here.
        order = np.lexsort((first_, marks))
        marks, first_, last_ = marks[order], first_[order], last_[order]
        used, columns = packs.dealt((marks.view(np.uint64) % np.uint64(parts)).astype(np.int64), parts,
                                    marks, first_.astype(np.uint32), last_.astype(np.uint32))
        return pa.Table.from_arrays([used, *columns], names=["part", "marks", "firsts", "lasts"])

    def gather(table):
        marks = packs.unpacked(table.column("marks"), np.int64)
        first, last = packs.unpacked(table.column("firsts"), np.uint32), packs.unpacked(table.column("lasts"), np.uint32)
        order = np.lexsort((first, marks))
        marks, first, last = marks[order], first[order], last[order]
        head = packs.heads(marks)
        edges = np.append(head, len(marks))
        return pa.table({"mark": pa.array(marks[head]), "firsts": packs.binaries(first, edges),
                         "lasts": packs.binaries(last, edges)})

    found = routed.groupBy("part").applyInArrow(cover, "part int, marks binary, firsts binary, lasts binary")
    return found.groupBy("part").applyInArrow(gather, "mark long, firsts binary, lasts binary")


def _removed(texts: DataFrame) -> DataFrame:
    """(mark, n_removed, kept, spans) of texts with covered stretches."""
    def remove(batches):
        for batch in batches:
            firsts, lasts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            raw, offsets = scan.texts(batch.column(1))
            gone_all, kept, n_spans, spans = [], [], [], []
            for i in range(batch.num_rows):
                data = raw[offsets[i]:offsets[i + 1]]
                cover = np.bincount(np.frombuffer(firsts[i], np.uint32), minlength=len(data) + 1) - np.bincount(
                    np.frombuffer(lasts[i], np.uint32), minlength=len(data) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                first, last = packs.spans_of(gone, np.zeros(len(gone), np.int8))
                gone_all.append(int(gone.sum()))
                kept.append(hashlib.sha256(np.ascontiguousarray(data[~gone])).hexdigest())
                spans.append(np.stack([first, last], axis=1))
                n_spans.append(len(first))
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(gone_all, pa.int64()), pa.array(kept, pa.string()),
                 pa.ListArray.from_arrays(
                     pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)),
                     pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])],
                                                names=["first", "last"]))],
                names=["mark", "n_removed", "kept", "spans"])

    return texts.select("mark", "text", "firsts", "lasts").mapInArrow(
        remove, "mark long, n_removed long, kept string, spans array<struct<first: long, last: long>>")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
            gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans, kept_sha256.

    ``spans`` are the removed stretches as (first, last) byte numbers, last exclusive, maximal
    and in order; ``kept_sha256`` hashes the other bytes. A byte goes if a ``window``-byte
    string over it also occurs in a document with a smaller id; documents of one id
    do not take from each other. Ids are integers; the null id is the least. Null texts are
    empty. Texts shorter than ``window`` keep all. Rows equal in id and text are judged
    alike. No rows give no rows; other columns are not read. ``window`` is at most 120.
    """
    if not gram < window <= 120:
        raise ValueError("gram < window <= 120")
    parts = partitions(docs.sparkSession)
    every, first, texts = probes.originals(probes.numbered(docs, key, text))

    def grams(raw, offsets):
        owner, hashes, *_ = segments(raw, offsets, window, gram)
        return owner, hashes, np.ones(len(owner), bool)

    met = written(probes.met(texts, grams, parts), "segment-hits")
    routed = _routed(probes.with_texts(texts, met), window, gram, parts)
    covered = written(_covered(routed, window, parts), "covered")
    gone = written(_removed(probes.with_texts(texts, covered)), "removed")
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    whole = written(texts.select("mark", F.length(body).cast("long").alias("n_bytes"),
                                 F.sha2(body, 256).alias("whole_sha256"))
                    .join(gone, "mark", "left").join(first, "mark"), "judged")
    copy = ~F.col("id").eqNullSafe(F.col("first_id"))
    cut = F.col("n_bytes") >= window
    none = F.expr("cast(array() as array<struct<first: long, last: long>>)")
    return every.join(whole, "mark").select(
        "id", "n_bytes",
        F.when(~copy, F.coalesce("n_removed", F.lit(0))).when(cut, F.col("n_bytes")).otherwise(0)
        .cast("long").alias("n_removed"),
        F.when(~copy, F.coalesce("spans", none))
        .when(cut, F.expr("array(named_struct('first', 0L, 'last', n_bytes))")).otherwise(none).alias("spans"),
        F.when(~copy, F.coalesce("kept", "whole_sha256")).when(cut, F.lit(_NONE))
        .otherwise(F.col("whole_sha256")).alias("kept_sha256"))
