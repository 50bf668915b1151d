"""Queries of the operators over the whole test tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import (alignment, anchors, codes, decontaminate, grades, jaccard, language,
                            mixing, rules, shards, suffixes, token_counts, urls)
from fleetgauge.llm.tables import table, written

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
#: The longest rule that fits a URL decides.
URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
#: Files of public tokenizers; set another folder where they lie elsewhere.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The values of the test tables; the queries take those of the documents instead.
MIX_NAMES = {"source": [f"src{i}" for i in range(20)], "lang": ["de", "en", "es", "fr"],
             "topic": ["lines", "long", "markup", "prose"]}


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.decide(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens",
                        "mix_probability", "mix_kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs)
    return (language.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"),
                    "lang_pred", "score"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    graded = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), grades.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return grades.score(docs, grades.learn(docs, graded)).withColumnRenamed("id", "doc_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("record_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = f"{TOKENIZERS}/{PIECES}"
    aligned = alignment.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{BYTE_BPE}", pieces)
    groups = F.col("groups")
    digest = F.when(groups == "", "").otherwise(F.sha2(F.encode(groups, "UTF-8"), 256))
    # The long spelled groups are not written, only their digest.
    kept = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return alignment.score(kept, len(alignment.load_pieces(pieces).table)).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256")


def op12_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{BYTE_BPE}")
    return counted.withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_jaccard_join, op3_url_filter, op4_mix_sources,
        op5_substring_dedup, op6_language_id, op7_quality_classifier, op8_suffix_array_dedup,
        op9_sharding, op10_quality_rules, op11_align_tokens, op12_count_tokens,
        op13_vector_codes)}


OP1_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS item_row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i
        FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size, -1) + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM windows))),
hits AS (SELECT doc_id, i, d.size, item FROM doc_windows d JOIN windows USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits))
            GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP2_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i
        FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id)
                                 + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = d.doc_id
GROUP BY d.doc_id
"""


OP5_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 20, -1) + 2)) AS i FROM doc_words)),
later AS (SELECT doc_id, i FROM windows
          QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc_words)
         ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (doc_id)
"""


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS win
            FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) // 2 - 50, -1) + 2)) AS i FROM docs)),
least AS (SELECT win, min(doc_id) AS m FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
         FROM windows JOIN least USING (win) WHERE m < doc_id),
counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS s
           FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)
           GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS t
         FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed,
       coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM docs),
worded AS (SELECT doc_id, host, line,
                  lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm
           FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS documents FROM docs GROUP BY host),
frequent AS (SELECT host, norm FROM worded JOIN hosts USING (host) GROUP BY host, norm, documents
             HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.05 * documents),
gone AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n
         FROM worded SEMI JOIN frequent USING (host, norm) GROUP BY doc_id),
tri AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, -1) + 2)) AS i FROM docs)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p
              FROM (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1))
        GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
  FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                  n_words - n_line_words < 0.5 * n_words AS depleted FROM counts)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM failed
"""


OP13_SQL = r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS n, vec_id, label, embedding AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT n, vec_id, label, part,
         list_transform(e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4],
                        lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM kept, (SELECT unnest(range(0, 4)) AS part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v AS c FROM pieces WHERE n <= 256),
""" + "".join(f"""
near{r} AS MATERIALIZED (
  SELECT n, part, any_value(p.v) AS v, min(256 * list_sum(list_transform(range(1, len(p.v) + 1),
             lambda i: (p.v[i] - b.c[i]) * (p.v[i] - b.c[i]))) + entry) AS k
  FROM pieces p JOIN book{r} b USING (part) GROUP BY n, part),
""" + (f"""sums{r} AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS m
  FROM (SELECT part, CAST(k % 256 AS BIGINT) AS entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM near{r})
  GROUP BY part, entry, pos),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(any_value(moved.c), any_value(b.c)) AS c FROM book{r} b
  LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY pos) AS c
             FROM sums{r} GROUP BY part, entry) moved USING (part, entry)
  GROUP BY b.part, b.entry),""" if r < 4 else "") for r in range(5)) + r"""
coded AS (
  SELECT n, string_agg(printf('%02x', CAST(k % 256 AS INTEGER)), '' ORDER BY part) AS code,
         CAST(sum(k // 256) AS BIGINT) AS error FROM near4 GROUP BY n),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (n) GROUP BY label),
print AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN coded USING (n) JOIN totals ON kept.label IS NOT DISTINCT FROM totals.label, print
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_jaccard_join": OP2_SQL,
            "op5_substring_dedup": OP5_SQL, "op8_suffix_array_dedup": OP8_SQL,
            "op10_quality_rules": OP10_SQL, "op13_vector_codes": OP13_SQL}
