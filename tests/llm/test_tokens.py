"""Token counts and alignment against the libraries themselves, text by text."""

import hashlib
import random
import unicodedata

import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from fleetgauge.llm import alignment, pretokens, queries, token_counts
from tests.llm import cases

BYTES = f"{queries.TOKENIZERS}/{queries.BYTE_BPE}"
PIECES = f"{queries.TOKENIZERS}/{queries.PIECES}"


def awkward(n=300, seed=5):
    """Texts of bits that tokenizers treat in ways of their own."""
    rng = random.Random(seed)
    bits = ["a", "The", " ", "  ", "\n", "\t", "é", "世界", "😀", " ", " ", "'s", "'", "<|endoftext|>",
            "<s>", "<0x41>", "1", "٣", "\x00", "!", "ß", "՘", "\U00010940", "\x85", "\x1c", "▁", "ﬁ", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


def rows():
    texts = awkward()
    return cases.documents(very_long=6000) + [(1000 + i, t) for i, t in enumerate(texts)] + [
        (1, texts[3]), (1, texts[3]), (None, "x y"), (2, "-" * 3000 + " " * 3000), (3, " "), (4, " a "), (5, "<|endoftext|>")]


@pytest.mark.parametrize("specials", [True, False])
def test_counts_are_the_librarys(spark, specials):
    data = rows()
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = not specials
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids),
                   n > 20) for i, t in data)
    found = token_counts.count(cases.frame(spark, data), BYTES, limit=20, specials=specials)
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    assert token_counts.count(cases.frame(spark, []), BYTES).count() == 0


def test_long_texts_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(pretokens, "LONG_TEXT", 200)
    monkeypatch.setattr(pretokens, "BLOCK_WORDS", 7)
    monkeypatch.setattr(pretokens, "WORDS", 50)
    known = pretokens.words(pretokens.load(BYTES, True))
    library = Tokenizer.from_file(BYTES)
    for text in [" ".join(awkward(60)), "the cat sat " * 500, *awkward(40, 9)]:
        assert known.counts([text, text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)] * 2
        known.make_room()
    assert len(known.known) - len(known.first) <= 50


def test_both_engines_cut_alike():
    slow, plain = regex.compile(pretokens.PATTERN), pretokens.spelled_out()
    for code in range(pretokens.PLAIN):
        text = f"a{chr(code)} {chr(code)}1{chr(code)}{chr(code)} "
        assert slow.findall(text) == plain.findall(text), hex(code)
    for text in ("it's I'LL we've'd 'mx", " \u00a0\u2003x  \n\n y", "a\x1c\x85b  ", "  "):
        assert slow.findall(text) == plain.findall(text)


def test_memory_keeps_as_many_words_as_asked():
    known = pretokens.words(pretokens.load(BYTES, True))
    known.counts([" ".join("zq" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(300))])
    held = len(known.known)
    known.make_room(1000, 100_000)
    assert len(known.known) == held
    known.make_room(100, 100_000)
    assert len(known.known) < held


def test_whole_tokens_are_single_tokens_and_skip_merging():
    shared = pretokens.load(BYTES, True)
    library = Tokenizer.from_file(BYTES)
    some = random.Random(1).sample(sorted(shared.whole), 500)
    assert all(library.encode(w, add_special_tokens=False).ids == [shared.whole[w]] for w in some)
    known = pretokens.words(shared)
    known.merge = None  # a text of proved words needs none
    assert known.counts([" the house is"]).tolist() == [3]


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level"):
        pretokens.load(f"{queries.TOKENIZERS}/word_bpe_49k.json", True)


def test_pattern_cuts_as_the_library_where_unicode_agrees():
    cut, pattern = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(pretokens.PATTERN)
    codes = [c for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")
             and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x17000 or 0x1B000 <= c < 0x20000 or c % 61 == 0)]
    for at in range(0, len(codes), 500):
        text = "".join(f"a{c}a1{c}1!{c}! {c} \n" for c in map(chr, codes[at:at + 500]))
        assert [o for _, o in cut.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)]


def spelled(library, model, text):
    """Token ids and bytes of both sides, or None."""
    alphabet = pretokens.byte_alphabet()
    a = library.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    raw_a = [bytes(alphabet[c] for c in library.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
    raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
             else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return ((a, raw_a), (b, raw_b)) if b"".join(raw_a) == whole == b"".join(raw_b) else None


def spans(ids, raw):
    at, out = 0, []
    for i, r in zip(ids, raw):
        out.append((i, at, at + len(r)))
        at += len(r)
    return out


def plain_alignment(data):
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    docs, holds = [], {}
    for key, text in data:
        both = spelled(library, model, text) if text else None
        if not both:
            docs.append((key, [], [], [], ""))
            continue
        a, b = (spans(*side) for side in both)
        links, first = [], 0
        for i, s, e in a:
            while b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends, groups, x, y = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0, 0
        for end in ends:
            left, right = [], []
            while x < len(a) and a[x][2] <= end:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        for pair in set(links):
            holds[pair] = holds.get(pair, 0) + 1
        docs.append((key, a, b, links, ";".join(groups)))
    best = {}
    for (a, _), n in holds.items():
        best[a] = max(best.get(a, 0), n)
    return sorted((str(key), len(a), len(b), groups.count(";") + bool(groups), len(links),
                   sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links),
                   hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                  for key, a, b, links, groups in docs)


@pytest.mark.parametrize("hot", [10_000, 40])
def test_alignment_equals_a_plain_walk(spark, hot):
    data = rows()
    aligned = alignment.written(alignment.align(cases.frame(spark, data), BYTES, PIECES), "aligned")
    size = len(alignment.load_pieces(PIECES).table)
    found = alignment.score(aligned, size, hot).collect()
    got = sorted((str(r.id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                  hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in found)
    assert got == plain_alignment(data)


def test_alignment_of_nothing(spark):
    aligned = alignment.written(alignment.align(cases.frame(spark, []), BYTES, PIECES), "aligned")
    assert alignment.score(aligned, 32_000).count() == 0
    aligned = alignment.written(alignment.align(cases.frame(spark, [(1, None), (2, "")]), BYTES, PIECES), "aligned")
    assert [(r.n_links, r.n_best, r.count_sum, r.groups) for r in alignment.score(aligned, 32_000).collect()] == [(0, 0, 0, "")] * 2


def test_queries_over_the_small_tables(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(map(str, r[:1])) + tuple(r[1:]) for r in queries.op11_align_tokens(spark, sf_dir).collect())
    assert got == plain_alignment(data)
    library = Tokenizer.from_file(BYTES)
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    assert sorted((r.doc_id, r.n_tokens) for r in queries.op12_count_tokens(spark, sf_dir).collect()) == want
