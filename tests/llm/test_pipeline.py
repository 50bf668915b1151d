"""The pipeline against a plain version of its stages, and its stages on odd inputs."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from fleetgauge.llm import mixing, shards
from fleetgauge.llm.queries import MIX_NAMES, SHARDS
from fleetgauge.llm.tables import DOCUMENT_COLUMNS
from tests.llm import cases
from tests.llm.test_pairs import expected as components_of
from tests.llm.test_texts import contaminated

ITEM = "the old item has just these fourteen words in it and no other one here"


def rows():
    rng = random.Random(8)
    found = [(r[0], r[1], "en", f"src{i % 3}") for i, r in enumerate(cases.documents(7, very_long=2000))
             if r[0] is not None]
    found += [(600 + i, cases.prose(rng, 40) + " " + ITEM + " tail", "en", "src1") for i in range(4)]
    found += [(700 + i, "||| " + cases.prose(rng, 60), None, "elsewhere") for i in range(20)]
    return found


def stored(spark, found, items, root):
    spark.createDataFrame([(k, t, lang, s, len(t or "")) for k, t, lang, s in found],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def plain_mix(found):
    def cell(text, lang, source):
        n = len(cases.PLAIN.findall(text))
        marks, lines = sum(c in "#*$%&|<>" for c in text), text.count("\n") + 1
        topic = ("markup" if marks * 5 > n else "lines" if lines * 8 > n else "long" if n >= 400 else "prose")
        return tuple(v if v in MIX_NAMES[d] else mixing.OTHER
                     for d, v in zip(mixing.DIMENSIONS, (source, lang, topic))), n

    cells = {}
    for _, text, lang, source in found:
        c, n = cell(text, lang, source)
        cells[c] = cells.get(c, 0.0) + n
    wanted = mixing.rake(cells, mixing.even_targets(cells, 0.7), 0.5)
    kept = []
    for r in found:
        c, _ = cell(*r[1:])
        name = f"7:{r[0]}:{zlib.crc32(r[1].encode())}"
        if int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2 ** 48 < wanted[c] / cells[c]:
            kept.append(r)
    return kept


def plain_shards(found):
    slots = {}
    for k, t, *_ in found:
        name = f"{k}:{zlib.crc32(t.encode())}"
        slot = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % shards.SLOTS
        slots.setdefault(slot, []).append((k, zlib.crc32(t.encode()), len(t.encode()) + 16))
    loads, place = [0] * SHARDS, {}
    for slot in sorted(slots, key=lambda s: (-sum(r[2] for r in slots[s]), s)):
        place[slot] = loads.index(min(loads))
        loads[place[slot]] += sum(r[2] for r in slots[slot])
    out, at = [], [0] * SHARDS
    for slot in sorted(slots):
        for k, crc, size in sorted(slots[slot]):
            out.append((k, size, crc, place[slot], at[place[slot]], slot))
            at[place[slot]] += 1
    return sorted(out)


def test_run_equals_the_plain_stages(spark, tmp_path):
    found = rows()
    items = [(1, ITEM), (2, None)]
    root = stored(spark, found, items, str(tmp_path))
    # All texts with a letter have a language; which one, the stage itself says.
    judged = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(
        spark, spark.read.parquet(f"{root}/documents.parquet"), root).collect()}
    kept = [(k, t, judged[k], s) for k, t, _, s in found if any(c.isalpha() for c in t or "")]
    assert set(judged) == {r[0] for r in kept}
    groups = {int(k): c for k, _, c in components_of(kept)}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    bad = {int(k) for k, *_, hit in contaminated([r[:2] for r in kept], items) if hit}
    assert bad == {600, 601, 602, 603}
    kept = plain_mix([r for r in kept if r[0] not in bad])
    got = sorted(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot"))
                 for r in corpus_pipeline.run(spark, root).collect())
    assert got == plain_shards(kept)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, tmp_path, name, stage):
    odd = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (2, "same text here", None, "s"),
           (2, "same text here", None, "s"), (None, "x " * 300, "en", "s"), (3, "\x00 \t", "zz", "")]
    root = stored(spark, odd, [(1, "solo"), (None, None)], str(tmp_path))
    docs = spark.read.parquet(f"{root}/documents.parquet")
    if stage is not corpus_pipeline.place:
        assert stage(spark, docs, root).columns == list(DOCUMENT_COLUMNS)
    assert stage(spark, docs, root).count() <= len(odd)
    assert stage(spark, docs.limit(0), root).count() == 0
    if stage is corpus_pipeline.drop_near_copies:
        assert sorted(str(r.doc_id) for r in stage(spark, docs, root).collect()) == [
            "1", "2", "3", "None", "None"]  # rows that repeat both id and text are one


def test_unlabelled_documents_are_kept(spark):
    rows = [(1, "clean words", None, "s"), (2, "12 !?", None, "s"), (3, None, None, "s")]
    # The id of the only labelled one is held out, so nothing is learned from it.
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 == 1)
    docs = cases.frame(spark, rows + [(held, "more words", "en", "s")])
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(1, None), (held, "en")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_drop_foreign_columns_whatever_their_names(spark, tmp_path, name, stage):
    rows = [(i, f"some words of text {i % 3} and more {'x' * (i % 3)}", "en", "s") for i in range(12)]
    root = stored(spark, rows, [(1, "solo")], str(tmp_path))
    docs = spark.read.parquet(f"{root}/documents.parquet").select(*DOCUMENT_COLUMNS)
    odd = docs.selectExpr("*", "'x' AS id", "1 AS mark", "2 AS mark2", "'y' AS id2", "3 AS `group`", "4 AS n_words",
                          "'z' AS lang_pred", "5 AS mix_kept", "6 AS size", "7 AS shard")
    plain, with_more = stage(spark, docs, root), stage(spark, odd, root)
    assert with_more.columns == plain.columns
    assert sorted(map(str, with_more.collect())) == sorted(map(str, plain.collect()))
