"""Token counts of whole texts by the whole-token shortcut.

``pretokens.load`` proves on the driver which vocabulary strings encode alone as one token.
A text is cut into pieces; a piece among the proved strings counts one without any merging,
and only the rest is merged by the library. Counts equal the library's for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm import pretokens, scan

#: Texts of more tokens are over the limit.
LIMIT = 1024


def count(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
          limit: int = LIMIT, specials: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row per row of ``docs``.

    ``path`` is a byte-level BPE tokenizer file; the driver reads it. Strings of its added
    tokens inside texts are those tokens, unless ``specials`` is false.

    A null or empty text has no bytes and no tokens. Texts of any length are counted whole,
    word block by word block. Repeated ids stay rows of their own, an id may be null, and an
    empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pretokens.load(path, specials))
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType())])

    def judge(batches):
        words = pretokens.words(shared.value)
        for batch in batches:
            _, offsets = scan.texts(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in scan.runs(offsets):
                tokens[a:b] = words.counts([t or "" for t in batch.column(1)[a:b].to_pylist()])
                words.make_room()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(tokens)],
                names=schema.names)

    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(judge, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
