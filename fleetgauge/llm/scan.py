"""Word scanning and hashing over whole Arrow batches of text.

A batch of texts is one run of UTF-8 bytes with offsets. Words are found with a
256-entry byte table, so that their borders, hashes and windows come from a few
vector operations per batch and no text is taken apart row by row. Nulls count as
empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about so many bytes, so memory does not follow the batch.
RUN_BYTES = 1 << 19

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def plain_words() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]+``: everything but white space."""
    table = np.ones(256, dtype=bool)
    table[list(_SPACES)] = False
    return table


def lexical_words() -> np.ndarray:
    """Byte table of digits, letters and every byte beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lowered() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """Row ranges (first, behind the last) of about ``limit`` bytes; a long text is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
    # Buffers of past batches would otherwise stay with the worker.
    pa.default_memory_pool().release_unused()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < length:
        step = np.full(length, _BASE, dtype=np.uint64)
        step[0] = 1
        back = np.full(length, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        _powers, _inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers[:length], _inverses[:length]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte times base to its place, modulo 2^64, before each place."""
    powers, _ = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever it lies."""
    _, inverses = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def gram_spans(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on; they may cross texts."""
    count = max(0, len(sums) - size)
    _, inverses = _tables(len(sums))
    return mix((sums[size:] - sums[:count]) * inverses[:count])


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of the words, and the n + 1 word offsets of the texts.

    A word never crosses the border of two texts.
    """
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = inside
    here = np.zeros(len(raw) + 1, dtype=bool)
    here[:-1] = inside
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; windows may cross texts."""
    count = max(0, len(word_hashes) - size + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + word_hashes[i:i + count]
    return mix(grams + np.uint64(size))


def windows_of(word_offsets: np.ndarray, size: int):
    """For windows of ``size`` words inside one text: their first words and texts."""
    counts = np.maximum(np.diff(word_offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first + word_offsets[:-1][text], text


def shingle_sets(word_hashes: np.ndarray, word_offsets: np.ndarray, size: int):
    """Distinct hashes of ``size``-word shingles of each text, sorted within a text.

    A text of fewer words, but not none, has its whole sequence as the only one.
    Gives the texts' rows and the hashes, ordered by both.
    """
    first, text = windows_of(word_offsets, size)
    grams = gram_hashes(word_hashes, size)[first] if len(first) else np.zeros(0, np.uint64)
    counts = np.diff(word_offsets)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            text = np.concatenate([text, rows])
            grams = np.concatenate([grams, gram_hashes(word_hashes, short)[word_offsets[rows]]])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return text[keep], grams[keep]
