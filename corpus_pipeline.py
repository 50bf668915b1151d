"""Corpus cleaning in five stages, each judging what its predecessor kept.

Language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding. Every stage
takes documents and returns documents; only the last returns placements. Stages read the
columns of documents by name and drop all others, whatever these are called; no rows give
no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontaminate, jaccard, language, mixing, shards
from fleetgauge.llm.queries import SHARDS
from fleetgauge.llm.tables import DOCUMENT_COLUMNS, small, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the others carry the predicted one. Where no
    language could be learned, those without a letter go and the others keep their own.

    Null and empty texts and texts without a letter go. Long texts are judged whole, a tie
    between languages goes to the first by name, repeated rows are judged alike and all stay.
    """
    model = language.learn(docs)
    judged = language.predict(docs, model)
    if model is None:
        return judged.filter("has_letter").select(*DOCUMENT_COLUMNS)
    return (judged.filter(F.col("lang_pred") != language.UNDETERMINED)
            .withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the least id.

    Null ids come last, of equal ids the least hash of the text stays, and rows that repeat
    both id and text are one. Null texts and texts without words are linked with nothing and
    stay. Texts are compared whole, however long.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = written(jaccard.join(docs), "near-copies")
    gone = written(jaccard.copies(found), "gone")
    mark = F.xxhash64("text")
    kept = docs.withColumn("mark", mark).join(
        small(gone.withColumnRenamed("mark", "mark2")),
        (F.col("mark") == F.col("mark2")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    if found.groupBy("id", "mark").count().filter("count > 1").isEmpty():
        return kept.select(*DOCUMENT_COLUMNS)
    # The same id with the same text twice or more: one row of them stays.
    return kept.dropDuplicates(["doc_id", "mark"]).select(*DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    Rows of one id and text are judged alike. Null and empty texts have no words and stay,
    null items match nothing, and without items all documents stay.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    mark = F.xxhash64("doc_id", "text")
    judged = decontaminate.decontaminate(docs.select(mark.alias("mark"), "text"),
                                         table(spark, sf_dir, "benchmark"), key="mark")
    bad = written(judged.filter("contaminated").select(F.col("id").alias("mark")).distinct(),
                  "contaminated")
    return (docs.withColumn("mark", mark).join(small(bad), "mark", "left_anti")
            .select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities.

    A null source or language is one of the others. Texts without words have probability 0
    and go, rows of one id and text are judged alike, and ties of probabilities do not matter:
    each row's ticket is a hash of its id and text.
    """
    return mixing.mix(docs).filter("mix_kept").select(*DOCUMENT_COLUMNS)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it.

    Null texts have the size of empty ones, repeated rows have places of their own, of rows
    equal in everything any order is taken, and no rows give none.
    """
    return shards.shard(docs, SHARDS).select(
        F.col("record_id").alias("doc_id"), "size", "text_crc32", "shard",
        F.col("place").alias("slot"), "virtual_slot")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place),
]

#: Language models and raking have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (last_name, last) = STAGES
    kept = functools.reduce(lambda frame, stage: written(stage[1](spark, frame, sf_dir), stage[0]),
                            first, docs)
    return last(spark, kept, sf_dir)
