"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The tokens of each cell are raked
until the marginals over sources, languages and topics meet their targets; the wanted
tokens of a cell over those it has are the probability of keeping a document of it. The
cells are those of the documents, in a written table; only a value that a list of names or
an explicit target leaves out counts as ``OTHER``, as does null. A table counted as small
is raked on the driver, a larger one by joins and sums over it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.tables import BROADCAST_ROWS, small, written

OTHER = "(other)"
#: Rounds of raking; each adapts to every marginal once.
ROUNDS = 60
DIMENSIONS = ("source", "lang", "topic")


def without(text: Column, characters: str, instead: str = "") -> Column:
    """The text with each of the characters replaced; far cheaper than translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def tokens_of(text: Column) -> Column:
    """Number of white-space separated words; null has none."""
    spaced = without(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", " ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """Topic by form: junk-like (many marks), list-like (short lines), long, or prose.

    The tables carry no topic; any string column can be passed in its place.
    """
    text = F.coalesce(text, F.lit(""))
    marks = F.octet_length(text) - F.octet_length(without(text, "#*$%&|<>"))
    lines = F.octet_length(text) - F.octet_length(without(text, "\n")) + 1
    return (F.when(marks * 5 > tokens, "markup").when(lines * 8 > tokens, "lines")
            .when(tokens >= 400, "long").otherwise("prose"))


def named(column: Column, names=None) -> Column:
    """The value, or ``OTHER`` for null and, if ``names`` are given, for what they leave out."""
    if names is None:
        return F.coalesce(column, F.lit(OTHER))
    return F.when(column.isin(*names), column).otherwise(F.lit(OTHER))


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], keep: float = 1.0,
         rounds: int = ROUNDS) -> dict[tuple, float]:
    """Tokens wanted of each cell, so that the marginals meet the targets.

    Targets are shares of ``keep`` times all tokens. Names without any cell leave their share
    to the others of their dimension in proportion; cells of names with target 0 get 0. A
    cell gives no more tokens than it has: what is cut there goes, as far as the other
    marginals let it, to the other cells of the same name in the following rounds.
    """
    keys = sorted(cells)
    have = np.array([cells[c] for c in keys], np.float64)
    total, wanted = keep * math.fsum(have), keep * have
    axes = []
    for axis, target in enumerate(targets):
        names = sorted({c[axis] for c in keys})
        at = {n: i for i, n in enumerate(names)}
        axes.append((np.array([at[c[axis]] for c in keys], np.int64),
                     np.array([target.get(n, 0.0) for n in names], np.float64)))
    for _ in range(rounds if keys else 0):
        for at, share in axes:
            sums = np.bincount(at, wanted, len(share))
            reach = math.fsum(share[sums > 0])
            if reach <= 0:
                continue
            scale = np.divide(share / reach * total, sums, out=np.zeros_like(sums), where=sums > 0)
            wanted = np.minimum(have, wanted * scale[at])
    return dict(zip(keys, wanted.tolist()))


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float,
               keep: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """rake() over a table (mix_source, mix_lang, mix_topic, tokens) of any size: the cells
    with their ``wanted``. Without targets they are those of even_targets()."""
    columns = [f"mix_{d}" for d in DIMENSIONS]
    total = keep * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    shares = []
    for d, column in zip(DIMENSIONS, columns):
        if targets:
            share = cells.sparkSession.createDataFrame(
                [(n, float(v)) for n, v in targets[d].items()], f"{column} string, share double")
        else:
            share = cells.groupBy(column).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
        shares.append(written(share, "shares"))
    wanted = cells.withColumn("wanted", keep * F.col("tokens"))
    for _ in range(rounds):
        for column, share in zip(columns, shares):
            # Shares need no common scale: they are divided by what can be reached.
            sums = written(wanted.groupBy(column).agg(F.sum("wanted").alias("s")).filter("s > 0")
                           .join(share, column), "sums")
            reach = sums.agg(F.sum("share")).first()[0] or 0.0
            if reach <= 0:
                continue
            scale = sums.select(column, (F.col("share") / reach * total / F.col("s")).alias("scale"))
            wanted = wanted.join(small(scale), column, "left").select(
                *columns, "tokens", F.least("tokens", F.col("wanted") * F.coalesce("scale", F.lit(0.0)))
                .alias("wanted"))
        wanted = written(wanted, "raked")
    return wanted


def even_targets(cells: dict[tuple, float], power: float) -> list[dict[str, float]]:
    """Targets per dimension: shares of the tokens raised to ``power`` and scaled to 1, so
    that a power under 1 gives small sources more room than they have."""
    found = []
    for axis in range(len(DIMENSIONS)):
        sums: dict[str, list] = {}
        for cell, weight in cells.items():
            sums.setdefault(cell[axis], []).append(weight)
        lifted = {n: math.fsum(w) ** power for n, w in sums.items() if math.fsum(w) > 0}
        whole = math.fsum(lifted.values())
        found.append({n: v / whole for n, v in lifted.items()})
    return found


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that the id, the text and the seed decide: equal on every run and
    on any number of machines."""
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("string")
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), crc)
    digits = F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 12), 16, 10)
    return digits.cast("double") / F.lit(float(1 << 48))


def probabilities(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float,
                  keep: float, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, mix_probability) of a written table of cells."""
    columns = [f"mix_{d}" for d in DIMENSIONS]
    if cells.count() > rows:
        return written(rake_table(cells, targets, power, keep).select(
            *columns, (F.col("wanted") / F.col("tokens")).alias("mix_probability")), "probabilities")
    # No more than ``rows`` by the count above.
    tokens = {tuple(r[c] for c in columns): r.tokens for r in cells.collect()}
    wanted = rake(tokens, [targets[d] for d in DIMENSIONS] if targets
                  else even_targets(tokens, power), keep)
    return cells.sparkSession.createDataFrame(
        [(*c, wanted[c] / tokens[c]) for c in sorted(tokens)],
        ", ".join(f"{c} string" for c in columns) + ", mix_probability double")


def mix(docs: DataFrame, names: dict[str, list[str]] | None = None,
        targets: dict[str, dict[str, float]] | None = None, power: float = 0.7,
        keep: float = 0.5, seed: int = 7, key: str = "doc_id",
        topic: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row with its cell, probability and decision.

    Every source, lang and topic of the documents is told apart, unless ``names`` lists the
    values to split by or, without it, ``targets`` names them: all others are ``OTHER``, as
    are nulls. ``targets`` gives shares for them; without, they are the corpus' own token
    shares raised to ``power``. ``keep`` is the share of all tokens to be sampled; more than
    ``rows`` cells are raked as a table. Adds mix_source, mix_lang, mix_topic, mix_tokens,
    mix_probability (tokens wanted of the cell over its tokens) and mix_kept. A row without
    words has probability 0 and is not kept; rows with the same id and text are judged
    alike; no rows give no rows. Input columns stay, but those with these names are replaced.
    """
    text, size = F.col("text"), F.col("mix_tokens")
    cut = docs.drop("mix_probability").withColumn("mix_tokens", tokens_of(text))
    keys = (F.col("source"), F.col("lang"), topic if topic is not None else form_topic(text, size))
    names = names or targets or {}
    cut = cut.withColumns({f"mix_{d}": named(k, names.get(d)) for d, k in zip(DIMENSIONS, keys)})
    columns = [f"mix_{d}" for d in DIMENSIONS]
    cells = written(cut.groupBy(*columns).agg(F.sum("mix_tokens").cast("double").alias("tokens"))
                    .filter("tokens > 0"), "cells")
    chances = small(probabilities(cells, targets, power, keep, rows), rows)
    # Rows without words have no part in a cell.
    chance = F.when(size > 0, F.coalesce("mix_probability", F.lit(0.0))).otherwise(0.0)
    return (cut.join(chances, columns, "left").select(*cut.columns, chance.alias("mix_probability"))
            .withColumn("mix_kept", uniform(F.col(key), text, seed) < F.col("mix_probability")))
