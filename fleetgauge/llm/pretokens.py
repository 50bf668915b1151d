"""Token ids of a byte-level BPE vocabulary, word by word.

Such a tokenizer cuts a text with a fixed pattern and merges inside each piece alone, so the
ids of a text are those of its pieces one after another. A piece that equals a vocabulary
string is usually one token; for which strings that holds is proved once, on the driver, by
encoding the whole vocabulary. All other pieces are merged by the library, each once for as
long as it stays in the worker's bounded memory.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from types import SimpleNamespace

import numpy as np
import regex

# The pattern of this family of tokenizers, and the marks of its files.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The classes of characters in it, which ``spelled_out`` replaces by their members.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: Beyond it the plain engine looks its ranges through one by one.
PLAIN = 0x10000
FLAGS = ("single_word", "lstrip", "rstrip", "normalized")
#: The newest Unicode tables on which the pattern was held against the library's classes.
CHECKED_UNICODE = "15.1.0"

#: Merged words that a worker remembers, and tokens of them, before it starts anew.
WORDS = 200_000
TOKENS = 2_000_000
#: Texts of more characters are cut into words block by block.
LONG_TEXT = 1 << 20
BLOCK_WORDS = 1 << 17


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: printable Latin-1 for
    itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def spelled_out() -> re.Pattern:
    """The fixed pattern for the plain engine, which is faster but lacks its classes: each is
    written as the ranges that the other engine gives it below ``PLAIN``, so that both cut
    texts of such characters alike."""
    every = "".join(map(chr, range(PLAIN)))
    letters, numbers, spaces = ("".join(
        f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{c}+", every)) for c in CLASSES)
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+"
                      rf"| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def _unassigned() -> bytes:
    """A byte per code point: 1 where Unicode tables may disagree about its class."""
    tables = unicodedata
    if tuple(map(int, unicodedata.unidata_version.split("."))) > tuple(map(int, CHECKED_UNICODE.split("."))):
        tables = unicodedata.ucd_3_2_0
    return bytes(tables.category(chr(code)) == "Cn" for code in range(0x110000))


def load(path: str, specials: bool) -> SimpleNamespace:
    """What tasks need of a tokenizer file, proved on the driver.

    ``specials``: strings of added tokens inside texts become those tokens, as is the
    library's default; else they are ordinary text. A file whose pieces are not cut by the
    fixed pattern alone is refused, since nothing is proved for it.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    told = json.loads(text)
    cut, model = told.get("pre_tokenizer") or {}, told["model"]
    if (model.get("type") != "BPE" or told.get("normalizer") or told.get("post_processor")
            or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
            or not cut.get("use_regex", True) or model.get("dropout")
            or any(a[f] for a in told["added_tokens"] for f in FLAGS)):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    added = {a["content"]: a["id"] for a in told["added_tokens"]}
    alphabet = byte_alphabet()
    decoded = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items() if s not in added}
    decoded |= {i: s.encode() for s, i in added.items()}
    table = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
    shared = SimpleNamespace(json=text, added=added if specials else {}, table=table,
                             unassigned=zlib.compress(_unassigned()), whole={}, words=None)
    shared.whole = whole_tokens(shared)
    return shared


def _tokenizer(shared: SimpleNamespace):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(shared.json)
    tokenizer.encode_special_tokens = True  # added tokens are cut out before
    return tokenizer


def whole_tokens(shared: SimpleNamespace) -> dict[str, int]:
    """The vocabulary strings that are one piece and that encode alone as their own token."""
    pattern, found = regex.compile(PATTERN), {}
    for number, raw in enumerate(shared.table):
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(word):
            found[word] = number
    encoded = _tokenizer(shared).encode_batch_fast(list(found), add_special_tokens=False)
    return {w: i for (w, i), e in zip(found.items(), encoded) if e.ids == [i]}


class Memory:
    """Token ids of words, each merged once, and which words their tokens spell exactly."""

    def __init__(self, first: dict, added: dict, table: list[bytes]):
        self.first, self.added, self.table = first, added, table
        self.forget()

    def forget(self) -> None:
        """Only the whole tokens stay known, and the added ones under a tuple of their id."""
        self.known = {w: n for n, w in enumerate(self.first)}
        self.known |= {(i,): len(self.first) + n for n, i in enumerate(self.added.values())}
        self.ids = np.array([*self.first.values(), *self.added.values()], np.int32)
        self.starts = np.arange(len(self.ids) + 1)
        self.exact = np.ones(len(self.ids), bool)

    def make_room(self, words: int | None = None, tokens: int | None = None) -> None:
        """Between runs: past the bounds, merged words are forgotten."""
        if len(self.known) - len(self.first) > (words or WORDS) or len(self.ids) > (tokens or TOKENS):
            self.forget()

    def merge(self, new: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def pieces(self, text: str) -> Iterator[list]:
        raise NotImplementedError

    def numbers(self, found: list) -> np.ndarray:
        """The number of each word; words not known yet are merged by the library."""
        new = list(set(found).difference(self.known))
        if new:
            ids, table = self.merge(new), self.table
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, lengths.sum())])
            self.exact = np.concatenate([self.exact, np.fromiter(
                (b"".join([table[i] for i in x]) == w.encode() for w, x in zip(new, ids)), bool, len(new))])
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def count(self, text: str) -> int:
        """Tokens of one text."""
        total = 0
        for found in self.pieces(text):
            numbers = self.numbers(found)
            total += int((self.starts[numbers + 1] - self.starts[numbers]).sum())
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; long ones are counted block by block."""
        if sum(map(len, texts)) > LONG_TEXT:
            return np.array([self.count(t) for t in texts], np.int64)
        numbers, edges = self._numbered(texts)
        sums = np.concatenate([[0], np.cumsum(self.starts[numbers + 1] - self.starts[numbers])])
        return np.diff(sums[edges])

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and the n + 1 word offsets of the texts."""
        lists = [list(chain.from_iterable(self.pieces(t))) for t in texts]
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return self.numbers(list(chain.from_iterable(lists))), edges

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, n + 1 offsets, and which texts their
        tokens spell byte by byte."""
        numbers, edges = self._numbered(texts)
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.arange(sums[-1]) - np.repeat(sums[:-1], lengths)
        wrong = np.concatenate([[0], np.cumsum(~self.exact[numbers])])[edges]
        return self.ids[np.repeat(self.starts[numbers], lengths) + inside], sums[edges], np.diff(wrong) == 0


def words(shared: SimpleNamespace) -> Words:
    """The worker's memory of words; it lives as long as the broadcast that holds ``shared``."""
    if shared.words is None:
        shared.words = Words(shared)
    return shared.words


class Words(Memory):
    """Pieces of the fixed pattern, whole tokens known from the start."""

    def __init__(self, shared: SimpleNamespace):
        super().__init__(shared.whole, shared.added, shared.table)
        self.tokenizer, self.pattern = _tokenizer(shared), regex.compile(PATTERN)
        self.plain = spelled_out()
        self.unassigned = np.frombuffer(zlib.decompress(shared.unassigned), bool)
        self.special = (regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None)

    def merge(self, new: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def pieces(self, text: str) -> Iterator[list]:
        """The words of a text in lists; an added token is a tuple of its id.

        A stretch with characters of no agreed class is one word: the library cuts it.
        """
        for part in self.special.split(text) if self.special else (text,):
            pattern = self.plain
            if part in self.added:
                yield [(self.added[part],)]
                continue
            if not part.isascii():
                codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
                if self.unassigned[codes].any():
                    yield [part]
                    continue
                if codes.max() >= PLAIN:
                    pattern = self.pattern
            if len(part) <= LONG_TEXT:
                yield pattern.findall(part)
            else:
                found = (m.group() for m in pattern.finditer(part))
                while block := list(islice(found, BLOCK_WORDS)):
                    yield block
