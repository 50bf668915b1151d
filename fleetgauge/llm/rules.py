"""Quality rules with line frequency across documents, with DataFrame functions only.

Every line is normalised and hashed; the documents of each host that hold it are counted.
Lines that more documents of a host hold than its limit are boilerplate and are taken out,
and a document that loses more than its share of words is rejected as depleted. Per-text
rules (words, symbols, repeated lines and repeated three-word windows) come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.tables import small, written

#: A line is boilerplate on a host if more than this many documents hold it ...
LINE_DOCUMENTS = 10
#: ... and more than this share of the host's documents.
LINE_SHARE = 0.05
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
#: Per-text rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

_OTHER_SPACES = "\t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

#: Words in three-word windows that occur twice or more. ``w`` are the words; windows are
#: sorted by hash with their places, so equal ones are neighbours and no map is searched.
_REPEATED = """
  transform(array(w), w -> if(size(w) < 4, 0,
    transform(array(sort_array(transform(sequence(0, size(w) - 3),
        i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)))),
      s -> transform(array(sort_array(transform(filter(s,
          (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)),
          x -> x.i))),
        at -> aggregate(transform(at, (p, k) -> least(3, coalesce(get(at, k + 1) - p, 3))),
                        0, (a, x) -> a + x))[0])[0]))[0]
"""


def without(text: Column, characters: str, instead: str = "") -> Column:
    """The text with each of the characters replaced; far cheaper than translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def line_words(text: Column) -> Column:
    """Array of (hash, words) of the normalised lines that have a word: lower case, inner
    white space squeezed, none at the ends."""
    squeezed = F.lower(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "))
    lines = F.array_remove(F.transform(F.split(squeezed, "\n"), lambda x: F.trim(x)), "")
    return F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("line"),
        (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text, character by character."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t\n\x0B\f\r]")))
    return F.size(lines) - F.size(F.array_distinct(lines))


def described(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The per-text counts and lines of every row, numbered."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                        body.alias("body"))
            .withColumn("spaced", without(F.col("body"), _OTHER_SPACES, " "))
            .withColumn("w", F.array_remove(F.split("spaced", " "), ""))
            .select("row", "id", "host", F.size("w").cast("long").alias("n_words"),
                    F.length(without(F.col("spaced"), " ")).cast("long").alias("word_chars"),
                    (F.octet_length("body") - F.octet_length(without(F.col("body"), _SYMBOLS)))
                    .cast("long").alias("n_symbols"),
                    repeated_lines(F.col("body")).cast("long").alias("n_dup_lines"),
                    F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
                    line_words(F.col("body")).alias("lines")))


def frequent_lines(lines: DataFrame, hosts: DataFrame, documents: int, share: float) -> DataFrame:
    """(host, line) above the limits; ``lines`` has one row per document and line."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("held"))
    return counts.filter(F.col("held") > documents).join(hosts, "host").filter(
        F.col("held") > share * F.col("documents")).select("host", "line")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE,
          least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per document: id, the counts, n_line_words, base_failed, depleted, kept.

    ``n_line_words`` are the words of its lines that are boilerplate on its host. Null and
    empty texts have no words and fail. A null host is a host of its own, as is an empty
    one (the same). Lines are counted once a document, whatever its copies; rows with the
    same id are documents of their own. No rows give no rows; other columns are not read.
    """
    base = written(described(docs, key, text, host), "described")
    hosts = base.groupBy("host").agg(F.count("*").alias("documents"))
    lines = (base.select("row", "host", F.explode("lines").alias("l"))
             .groupBy("row", "host", F.col("l.line").alias("line"))
             .agg(F.sum("l.words").alias("words")))
    lines = written(lines, "lines")
    frequent = written(frequent_lines(lines, hosts, documents, share), "frequent-lines")
    gone = lines.join(small(frequent), ["host", "line"], "left_semi").groupBy("row").agg(
        F.sum("words").alias("gone"))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (base.drop("lines").join(gone, "row", "left")
            .withColumn("n_line_words", F.coalesce("gone", F.lit(0)).cast("long"))
            .withColumn("base_failed", failed)
            .withColumn("depleted", F.col("n_words") - F.col("n_line_words")
                        < least_left * F.col("n_words"))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
            .select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "n_line_words", "base_failed", "depleted", "kept"))
