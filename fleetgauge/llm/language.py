"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with counts of the
bytes that followed. The code length of a byte is that of its longest context known to
the language, with an escape (method C: distinct followers over total plus distinct)
for each longer context that has not seen it; below order 0 all 256 bytes are equal. The
counts are frozen after training, so the code length of a text is the exact sum over its
bytes, whatever the order in which texts come. The language with the shortest code wins.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import scan

UNDETERMINED = "und"
#: Longest context in bytes.
ORDER = 3
#: Training takes about so many bytes of each language, as whole texts chosen by hash.
TRAIN_BYTES = 2_000_000

PREDICTION = "lang_pred string, score double, has_letter boolean, bits_per_byte double"


#: What build() gives. Costs are code lengths in bits, one column per language (sorted by
#: name). ``symbols`` maps a byte to a small number, the last standing for bytes never seen
#: in training. Three bytes index ``short`` directly (order 2); a known three-byte context
#: has a row block in ``long``, found through ``block``.
Model = SimpleNamespace


def _grams(raw: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Every ``size``-byte gram inside one text, as a number."""
    if len(raw) < size:
        return np.zeros(0, np.int64)
    value = np.zeros(len(raw) - size + 1, np.int64)
    for i in range(size):
        value = (value << 8) | raw[i:len(value) + i]
    starts = np.arange(len(value))
    text_end = offsets[np.searchsorted(offsets, starts, side="right")]
    return value[starts + size <= text_end]


def gram_counts(docs: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, n) over whole texts, counted per batch before the exchange."""
    def count(batches):
        for batch in batches:
            labels = np.asarray(batch.column(1).to_pylist(), dtype=object)
            raw, offsets = scan.texts(batch.column(0))
            raw = scan.lowered()[raw]
            for name in sorted(set(labels)):
                rows = np.flatnonzero(labels == name)
                own = np.concatenate([raw[offsets[r]:offsets[r + 1]] for r in rows])
                own_offsets = np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])
                for size in range(1, order + 2):
                    grams, n = np.unique(_grams(own, own_offsets, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.string()),
                         pa.array(np.full(len(grams), size, np.int32)),
                         pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "size", "gram", "n"])

    found = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(
        count, "lang string, size int, gram long, n long")
    return found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def training_rows(labelled: DataFrame, key: Column, text: str, lang: str,
                  train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Whole labelled texts, about ``train_bytes`` of each language.

    A row is taken when a hash of its id falls under the share that the language needs, so
    nothing is sorted and the choice is the same on every run. Texts longer than an eighth
    of the bound are not drawn, so the sample cannot run far over it. Every language that
    has text is learned, however few its rows: its text of the least hash is always taken,
    and where its shorter texts are under an eighth of the bound, its shortest longer one.
    """
    size, limit = F.octet_length(F.col(text)), train_bytes // 8
    ticket = F.pmod(F.xxhash64(key.cast("string"), F.lit("train")), F.lit(1_000_000))
    mark = F.xxhash64(F.col(lang), key.cast("string"), F.col(text))
    fit = labelled.filter(F.col(lang).isNotNull() & (size > 0))
    short = size <= limit
    # Ticket or size above some bits of the mark, in one number, so that nothing is sorted.
    rank = F.when(short, ticket * (1 << 43) + F.pmod(mark, F.lit(1 << 43))).otherwise(
        size.cast("long") * (1 << 32) + F.pmod(mark, F.lit(1 << 32)))
    # One row per language.
    sums = fit.groupBy(lang).agg(
        F.coalesce(F.sum(F.when(short, size)), F.lit(0)).alias("bytes"),
        F.min(F.when(short, rank)).alias("least"),
        F.min(F.when(~short, rank)).alias("shortest")).collect()
    if not sums:
        return fit.limit(0)
    least = [r.least for r in sums if r.least is not None]
    shortest = [r.shortest for r in sums if r.shortest is not None and r.bytes < limit]
    pick = F.lit(0.0)
    for name, rate in sorted((r[lang], min(1.0, train_bytes / r.bytes)) for r in sums if r.bytes):
        pick = F.when(F.col(lang) == name, F.lit(rate)).otherwise(pick)
    return fit.filter(F.when(short, (ticket / 1e6 < pick) | rank.isin(least)).otherwise(
        rank.isin(shortest)))


def build(rows, order: int = ORDER) -> Model | None:
    """The model of collected gram counts, an Arrow table or rows; its size follows the
    training bound."""
    if not len(rows):
        return None
    if not isinstance(rows, pa.Table):
        rows = pa.table({c: pa.array([r[c] for r in rows]) for c in ("lang", "size", "gram", "n")})
    coded = rows["lang"].combine_chunks().dictionary_encode()
    found = np.array(coded.dictionary.to_pylist(), dtype=object)
    names = sorted(found)
    lang = np.searchsorted(np.array(names, dtype=object), found)[coded.indices.to_numpy()]
    size, gram = rows["size"].to_numpy(), rows["gram"].to_numpy()
    n = rows["n"].to_numpy().astype(np.float64)
    seen = np.unique(gram[size == 1])
    symbols = np.full(256, len(seen), np.int32)  # 256 symbols to the third still fit
    symbols[seen] = np.arange(len(seen))
    width = len(seen) + 1

    # Order 0 over all bytes; a byte that the language never saw costs the escape and 8 bits.
    zero = np.zeros((width, len(names)))
    own = size == 1
    np.add.at(zero, (symbols[gram[own]], lang[own]), n[own])
    total, kinds = zero.sum(0), (zero > 0).sum(0)
    with np.errstate(divide="ignore"):
        cost = np.where(zero > 0, -np.log2(zero / (total + kinds)), 8 - np.log2(kinds / (total + kinds)))

    def deeper(below, context, follow, where, contexts):
        """Costs of contexts x symbols x languages, from the costs one order lower."""
        counts = np.zeros((contexts, width, len(names)))
        np.add.at(counts, (context, follow, lang[where]), n[where])
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            coded = -np.log2(counts / (total + kinds))
        return np.where(counts > 0, coded, escape + below)

    def part(values, back):
        return symbols[(values >> (8 * back)) & 255]

    two = size == 2
    g = gram[two]
    one = deeper(cost[None], part(g, 1), part(g, 0), two, width)
    three = size == 3
    g = gram[three]
    short = np.zeros((width * width, width, len(names)), np.float32)
    for first in range(width):  # one leading byte at a time keeps the work small
        inside = part(g, 2) == first
        short[first * width:(first + 1) * width] = deeper(
            one, part(g[inside], 1), part(g[inside], 0), np.flatnonzero(three)[inside], width)
    four = size == 4
    g = gram[four]
    code = (part(g, 3) * width + part(g, 2)) * width + part(g, 1)
    contexts, row = np.unique(code, return_inverse=True)
    block = np.full(width ** 3, -1, np.int32)
    block[contexts] = np.arange(len(contexts))
    # A block per known context, in single precision: sums are made in double.
    long = np.zeros((len(contexts), width, len(names)), np.float32)
    tail = contexts % (width * width)
    for first in range(0, len(contexts), 4096):
        last = min(first + 4096, len(contexts))
        inside = (row >= first) & (row < last)
        where = np.flatnonzero(four)[inside]
        long[first:last] = deeper(short[tail[first:last]], row[inside] - first,
                                  part(g[inside], 0), where, last - first)
    return Model(languages=names, symbols=symbols, count=width, block=block,
                 short=short.reshape(-1, len(names)), long=long.reshape(-1, len(names)))


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language. A text's first bytes have space before them."""
    rows = len(offsets) - 1
    s = model.symbols[raw]
    space = model.symbols[0x20]
    before = [s]
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
    for back in range(1, ORDER + 1):
        shifted = np.full(len(s), space)
        shifted[back:] = s[:-back]
        before.append(np.where(place >= back, shifted, space))
    w = model.count
    tail = before[2] * w + before[1]
    block = model.block[before[3] * (w * w) + tail]
    known = block >= 0
    blocks = block[known].astype(np.int64) * w + s[known]
    text = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    bits = np.zeros((rows, len(model.languages)))
    for at in range(len(model.languages)):
        cost = model.short[tail * w + s, at].astype(np.float64)
        cost[known] = model.long[blocks, at]
        bits[:, at] = np.bincount(text, weights=cost, minlength=rows)
    return bits


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with lang_pred, score, has_letter and bits_per_byte.

    A null or empty text, or one without any letter, is ``und`` with score 0; so is
    every text when nothing was learned. The score is the best language's share of the
    evidence per byte: 1 / (1 + the sum of 2^-(gap in bits) over the others). Columns of
    those four names are replaced; all others stay, as do repeated rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "has_letter", "bits_per_byte")
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    shaped = docs.withColumn("has_letter", letter)
    schema = shaped.drop("has_letter").schema.add("has_letter", "boolean").add(
        "lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    at = shaped.columns.index(text)

    def judge(batches):
        known = shared.value
        low = scan.lowered()
        for batch in batches:
            raw, offsets = scan.texts(batch.column(at))
            rows = batch.num_rows
            best, score, per_byte = np.full(rows, -1), np.zeros(rows), np.zeros(rows)
            if known is not None:
                for a, b in scan.runs(offsets):
                    own = offsets[a:b + 1] - offsets[a]
                    bits = code_lengths(known, low[raw[offsets[a]:offsets[b]]], own)
                    best[a:b] = bits.argmin(1)
                    least = bits.min(1)
                    gap = np.minimum(bits - least[:, None], 1000.0)
                    score[a:b] = 1 / np.exp2(-gap).sum(1)
                    per_byte[a:b] = least / np.maximum(np.diff(own), 1)
            letters = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            judged = letters & (best >= 0)
            names = np.array([*(known.languages if known else []), UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[np.where(judged, best, -1)], pa.string()),
                 pa.array(np.where(judged, score, 0.0)), pa.array(np.where(judged, per_byte, 0.0))],
                names=[f.name for f in schema])

    return shaped.mapInArrow(judge, schema)


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text leaves 1 modulo 3."""
    crc = F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))
    return F.pmod(crc, F.lit(3)) == 1


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          train_bytes: int = TRAIN_BYTES) -> Model | None:
    """The frozen model of the rows that are not held out and have a language."""
    labelled = docs.filter(~held_out(F.col(key))).select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = training_rows(labelled, F.col("id"), "text", "lang", train_bytes)
    return build(gram_counts(rows, "text", "lang").toArrow())
