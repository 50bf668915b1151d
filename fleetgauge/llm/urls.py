"""URL filter: rules by host and path, and boosted trees on lexical features for the rest.

The longest rule that fits decides. All other URLs are judged by gradient-boosted trees over
features of the URL text alone: lengths, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix over all labelled URLs. The trees learn from a bounded sample.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.tables import small, written

#: The trees learn from about so many labelled URLs, chosen by a hash of the URL.
SAMPLE_ROWS = 8000
#: Boosting rounds and depth of a tree.
ROUNDS = 10
DEPTH = 4
#: Labelled URLs that an unknown suffix counts as, half of them blocked.
PRIOR = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy",
            "parameters", "fragment", "hyphens", "longest_label", "suffix_rate", "suffix_weight")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the characters' frequencies."""
    kinds = F.array_distinct(F.split(text, ""))
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0),
                       lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the host's suffix to rows with url, host and path."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    count = lambda c, char: F.length(c) - F.length(F.translate(c, char, ""))
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "suffix": suffix_of(host),
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": count(path, "/").cast("double"),
        "labels": F.size(labels).cast("double"),
        "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(1.0 + count(query, "&")),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "hyphens": count(url, "-_").cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double")})


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` of the labelled URLs, chosen by a hash of the URL."""
    whole = labelled.count()
    draw = F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1_000_000)) / 1e6
    return labelled.filter(draw < min(1.0, rows / max(whole, 1)))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_rate, suffix_weight) of URLs with host and verdict: smoothed share of
    blocked URLs and log count."""
    blocked = F.sum((F.col("verdict") == "block").cast("double"))
    return labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(
        ((blocked + PRIOR / 2) / (F.count("*") + PRIOR)).alias("suffix_rate"),
        F.log1p(F.count("*")).alias("suffix_weight"))


class Model(NamedTuple):
    """Fitted trees and suffix statistics; without trees every URL gets ``usual``."""
    trees: object
    suffixes: DataFrame | None
    usual: str


def _assembled(frame: DataFrame, suffixes: DataFrame) -> DataFrame:
    joined = frame.join(small(suffixes), "suffix", "left").fillna(
        {"suffix_rate": 0.5, "suffix_weight": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trees from URLs with a ``verdict``; with one verdict only, that verdict for all,
    with none, allow."""
    chosen = written(sample(lexical(labelled), rows).withColumn(
        "label", (F.col("verdict") == "block").cast("double")), "labelled-urls")
    seen = {r.verdict for r in chosen.select("verdict").distinct().collect()}
    if len(seen) < 2:
        return Model(None, None, *(seen or {"allow"}))
    suffixes = written(suffix_statistics(labelled), "suffixes")
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=1, cacheNodeIds=False).fit(
        _assembled(chosen, suffixes).select("features", "label"))
    return Model(trees, suffixes, "allow")


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Every row's id, url, host, path, rule and rule verdict (null without a rule)."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    # Null urls have an empty host and path.
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")),
                             "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": name, "verdict": verdict})


def decide(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None,
           key: str = "page_id", url: str = "url", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_probability.

    ``labelled`` has url, host, path and verdict; without it, the URLs that a rule decides
    are the labelled ones. The verdict is the rule's, else block where the trees give a
    probability of a half or more. The probability is null where a rule decides or nothing
    could be learned. Null urls and urls without ``://`` have an empty host and path and are
    judged like others. Repeated rows are judged alike; other columns are not read.
    """
    found = judged(pages, rules, key, url)
    model = learn((labelled if labelled is not None else found.filter("rule is not null"))
                  .select("url", "host", "path", "verdict"), rows)
    if model.trees is None:
        return found.select("id", "host", "path", "rule",
                            F.coalesce("verdict", F.lit(model.usual)).alias("verdict"),
                            F.lit(None).cast("double").alias("block_probability"))
    scored = model.trees.transform(_assembled(lexical(found), model.suffixes))
    chance = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    return scored.select("id", "host", "path", "rule", "verdict", chance.alias("block_probability")).select(
        "id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
        .alias("verdict"), "block_probability")
