"""Quality by ordinal cumulative-link regression on hashed text.

One weight per hashed feature and one threshold per step of the grade: the chance of a grade
of at least k is the logistic of the text's score minus the k-th threshold, and the
thresholds rise. Features are the words of a text and their first four and five bytes, each
present or not. The fit takes a bounded sample of graded rows; scoring is a sum of weights
per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import scan
from fleetgauge.llm.tables import small, written

#: Hashed features, and the most graded rows that the fit takes (chosen by a hash of the id).
FEATURES = 1 << 16
SAMPLE_ROWS = 6000
GRADES = 3
ROUNDS = 200
#: Price of a weight, and how many or what share of the sample's rows a feature may have.
SPARSE = 0.003
RARE = 5
COMMON = 0.3


def present(raw: np.ndarray, offsets: np.ndarray):
    """(text, feature) of the distinct features of each text, ordered by both."""
    folded = scan.lowered()[raw]
    starts, ends, heads = scan.words(folded, offsets, scan.lexical_words())
    sums = scan.prefix_sums(folded)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(heads))
    found = []
    for kind, last in enumerate((ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 5))):
        hashes = scan.span_hashes(sums, starts, last) + np.uint64(kind)
        found.append(text * FEATURES + (scan.mix(hashes) % np.uint64(FEATURES)).astype(np.int64))
    codes = np.unique(np.concatenate(found)) if len(text) else np.zeros(0, np.int64)
    return codes // FEATURES, codes % FEATURES


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when(toxic.isNotNull(), 1 + quality).cast("int")


def sample(graded: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` different graded rows (id, grade), chosen by a hash of the id. Rows that
    repeat both id and grade are one, so an id gives at most as many rows as it has grades."""
    fit = graded.filter(F.col("grade").isNotNull() & F.col("id").isNotNull()).select("id", "grade").distinct()
    whole = fit.count()
    draw = F.pmod(F.xxhash64("id", F.lit("grade")), F.lit(1_000_000)) / 1e6
    return fit.filter(draw < min(1.0, rows / max(whole, 1)))


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = ROUNDS):
    """(weights, thresholds) of the greatest likelihood less ``SPARSE`` times the sum of the
    weights' sizes, by accelerated proximal steps; each grade counts alike in all.

    Features of fewer than ``RARE`` rows or more than ``COMMON`` of them get no weight: the
    first only tell single rows apart, the second say little.
    """
    n, at = len(rows), np.arange(len(rows))
    feature = np.concatenate(rows)
    text = np.repeat(at, [len(r) for r in rows])
    held = np.bincount(feature, minlength=FEATURES)
    use = ((held >= RARE) & (held <= COMMON * n))[feature]
    feature, text = feature[use], text[use]
    weight = 1 / np.bincount(grades, minlength=GRADES).clip(1)[grades]
    weight /= weight.sum()
    # Steps by feature: rows' curvature is at most a quarter of their weight and spread.
    many = np.bincount(text, minlength=n) + GRADES
    step = 1 / np.maximum(0.25 * np.bincount(feature, weights=(weight * many)[text], minlength=FEATURES), 1e-6)
    threshold_step = 1 / (0.25 * float((weight * many).sum()))
    share = np.array([weight[grades >= k].sum() for k in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
    weights, thresholds = np.zeros(FEATURES), -np.log(share / (1 - share))
    ahead, ahead_t, pace = weights, thresholds, 1.0
    for _ in range(rounds):
        score = np.bincount(text, weights=ahead[feature], minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - ahead_t, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        chance = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        up, down = weight * slope[at, grades] / chance, weight * slope[at, grades + 1] / chance
        moved = ahead + step * np.bincount(feature, weights=(up - down)[text], minlength=FEATURES)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSE, 0)
        pull = np.array([down[grades == k - 1].sum() - up[grades == k].sum() for k in range(1, GRADES)])
        new_t = np.maximum.accumulate(ahead_t + threshold_step * pull + 0.01 * np.arange(GRADES - 1)) \
            - 0.01 * np.arange(GRADES - 1)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - weights)
        ahead_t = new_t + (pace - 1) / faster * (new_t - thresholds)
        ahead_t = np.maximum.accumulate(ahead_t + 0.0) + 0.01 * (np.diff(ahead_t, prepend=-np.inf) <= 0)
        weights, thresholds, pace = new, new_t, faster
    return weights, thresholds


def learn(docs: DataFrame, graded: DataFrame, rows: int = SAMPLE_ROWS):
    """The model of a sample of graded documents; None without two grades.

    ``docs`` has id and text, ``graded`` id and grade. An id with several grades or texts counts
    with each, rows that repeat all three once. At most twice ``rows`` rows of feature numbers
    come to the driver; where ids with very many texts would give more, those of the least hash.
    Long texts are read whole; without grades or documents there is no model.
    """
    chosen = written(sample(graded, rows), "graded")

    def hashed(batches):
        for batch in batches:
            raw, offsets = scan.texts(batch.column(0))
            for a, b in scan.runs(offsets):
                text, feature = present(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                edges = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.array([feature[x:y].astype(np.uint32).tobytes()
                               for x, y in zip(edges[:-1], edges[1:])], pa.binary())],
                    names=["grade", "mark", "features"])

    # The sample is written and counted before it is broadcast; what comes back is cut by mark.
    found = (docs.select("id", "text").join(small(chosen), "id")
             .select("text", "grade", F.xxhash64("id", "grade", "text").alias("mark")).dropDuplicates(["mark"])
             .mapInArrow(hashed, "grade int, mark long, features binary")
             .orderBy("mark").limit(2 * rows).collect())
    found = sorted(found, key=lambda r: (r.grade, bytes(r.features)))
    grades = np.array([r.grade for r in found], np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    return fit([np.frombuffer(r.features, np.uint32).astype(np.int64) for r in found], grades)


def score(docs: DataFrame, model, least: int = 1) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) of every row of (id, text).

    The expected grade runs from 0 to 2. The tail probability is that of a grade of at least
    ``least``, and a row is kept if it is a half or more. Null and empty texts have no
    features and get the thresholds' own chances. Without a model all rows have grade 2 and
    are kept. Repeated rows are judged alike; no rows give no rows. Very long texts are read
    whole, and a tail probability of exactly a half is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            raw, offsets = scan.texts(batch.column(1))
            rows = batch.num_rows
            expected, tail = np.full(rows, GRADES - 1.0), np.ones(rows)
            if shared.value is not None:
                weights, thresholds = shared.value
                for a, b in scan.runs(offsets):
                    text, feature = present(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    sums = np.bincount(text, weights=weights[feature], minlength=b - a)
                    tails = 1 / (1 + np.exp(-np.clip(sums[:, None] - thresholds, -30, 30)))
                    expected[a:b], tail[a:b] = tails.sum(1), tails[:, least - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= 0.5)],
                names=["id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(
        judge, f"id {kind}, expected_grade double, tail_probability double, kept boolean")
