"""Encoding of text by a byte-level BPE vocabulary, with an automaton compiled from its merges.

1. Merge gadgets. The automaton of correct tokenizations reads tokens. It starts as one state with a loop for
   every byte; each merge (u, v) -> uv, in order, adds one gadget: the state after u loses its arc v, a new state
   after uv starts as a copy of the state after v, and every state with an arc u gets an arc uv. As an arc's
   target depends on its label only, a gadget is three numbers: the arc that is cut, the state copied and the
   label followed, each with the time of the merge; ``arc`` resolves them.
2. Determinising over bytes. A token spells several bytes, so over bytes the automaton is not deterministic:
   after some bytes it may be within tokens that began at different places. A state of the deterministic one is
   the list of these: for each place the token that ends there and the node of the token trie reached since. As
   every prefix has one correct tokenization, with each byte exactly one token ends in an accepted way; it is the
   output of the transition. States and transitions are made when first reached and kept in a table.
3. Encoding. A word of the pre-split text is read byte by byte through the table, never stepping back; the path is
   then read from its end: the output at the last byte is the last token, before it stands the output at the byte
   where it began, and so on. Paths of words are kept in a table of bounded size. Decoding emits the arcs' labels.

Defined cases: null and empty texts give an empty list; blank texts are tokenized as they are; strings of
special tokens in a text are ordinary text; bytes that aren't UTF-8 are read as U+FFFD. Only the column named
is read. The vocabulary's path is a parameter; the driver reads the file and broadcasts its 1.5 MB.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-split pattern of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_WORDS, MOST_STATES = 200_000, 300_000


def plain_pattern() -> str:
    """PATTERN for Python's own engine, which is faster but knows no \\p: its classes written out for the characters up to U+FFFF, from a rule."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = lambda kind: "".join(f"\\u{ord(m.group()[0]):04x}-\\u{ord(m.group()[-1]):04x}" for m in regex.finditer(f"{kind}+", every))
    letter, number, blank = runs(r"\p{L}"), runs(r"\p{N}"), runs(r"\s")
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


def printable() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves, the other bytes follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of a vocabulary file with ``model.vocab`` and ``model.merges``."""

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        byte = printable()
        names = {k: i for k, i in model["vocab"].items() if all(c in byte for c in k)}
        self.labels = {i: bytes(byte[c] for c in k) for k, i in names.items()}
        size = max(names.values()) + 1
        self.born, self.copied, self.followed = [0] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        merged = {names[c] for c in byte}
        for time, merge in enumerate(model["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            u, v, uv = names[a], names[b], names[a + b]
            if uv in merged:
                raise ValueError(f"{a + b} is merged twice")
            if u in merged and v in merged and self._open(u, v, time - 1):
                self.cut[u, v], self.born[uv], self.copied[uv], self.followed[uv] = time, time, v, u
                merged.add(uv)
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]  # of each node of the token trie: the token that ends there, whether it leads on
        for i in merged:
            at = 0
            for byte_ in self.labels[i]:
                to = self.child.get(at << 8 | byte_)
                if to is None:
                    to = self.child[at << 8 | byte_] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[at] = True
                at = to
            self.token_at[at] = i
        self.size_of = {i: len(self.labels[i]) for i in merged}
        self.reset()
        self.words = _Words(self)
        self.any_split, self.plain_split = regex.compile(PATTERN).findall, re.compile(plain_pattern()).findall
        self.bytes_of = np.zeros(size, np.int32)
        for i, label in self.labels.items():
            self.bytes_of[i] = len(label)

    def _open(self, s: int, t: int, now: float) -> bool:
        """Whether the state after s has the arc t once the merges up to now are in."""
        while True:
            cut = self.cut.get((s, t))
            if cut is not None and cut <= now:
                return False
            if self.born[t] == self.born[s] == 0:
                return True
            if self.born[t] >= self.born[s]:
                now = self.born[t]
                t = self.followed[t]
            else:
                now = self.born[s] - 1
                s = self.copied[s]

    def arc(self, s: int, t: int) -> bool:
        known = self.arcs.get((s, t))
        if known is None:
            known = self._open(s, t, float("inf"))
            if len(self.arcs) > 4 * MOST_WORDS:
                self.arcs.clear()
            self.arcs[s, t] = known
        return known

    def reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.number = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}  # state and byte -> state << 8, token that ends here

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state (times 256) by a byte, made and kept in the table."""
        threads, ends = [], -1
        for s, node in self.states[state >> 8]:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                t = self.token_at[to]
                if t >= 0 and ends < 0 and (s < 0 or self.arc(s, t)):
                    ends = t
                if self.inner[to]:
                    threads.append((s, to))
        key = (*threads, (ends, 0))
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        self.table[state | byte] = n << 8, ends
        return n << 8, ends

    def word(self, w: bytes) -> tuple[int, ...]:
        """The accepting path that spells w."""
        if len(self.states) > MOST_STATES:
            self.reset()
        table, state, ends = self.table, 0, []
        for byte in w:
            to = table.get(state | byte)
            state, t = self.step(state, byte) if to is None else to
            ends.append(t)
        path, at, size = [], len(w), self.size_of
        while at:
            t = ends[at - 1]
            path.append(t)
            at -= size[t]
        return tuple(path[::-1])

    def split(self, text: str) -> list[str]:
        plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)  # no character over U+FFFF
        return (self.plain_split if plain else self.any_split)(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Paths by word, as the bytes of their int32 ids, which join fast; filled on demand, emptied when there are MOST_WORDS, words over 200 bytes aren't kept."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton

    def __missing__(self, w: str) -> bytes:
        b = w.encode("utf-8", "replace")
        path = np.array(self.automaton.word(b), np.int32).tobytes()
        if len(b) <= 200:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[w] = path
        return path


_compiled: dict[int, TokenAutomaton] = {}


def compiled(file: bytes) -> TokenAutomaton:
    """The automaton of a file's content, compiled once in each Python process."""
    key = zlib.crc32(file)
    if key not in _compiled:
        _compiled[key] = TokenAutomaton(file)
    return _compiled[key]


def vocabulary(spark: SparkSession, path: str = BYTE_BPE_50K):
    """The vocabulary file as a broadcast variable."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def texts(column: pa.Array) -> list[str]:
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def encode(text: Column, vocab) -> Column:
    """array<int>: the token ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        a = compiled(vocab.value)
        rows = [a.ids(t) for t in texts(column)]
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))

    return ids(text.cast("binary"))


def count_tokens(text: Column, vocab) -> Column:
    """bigint: the number of tokens of a text column, 0 for null."""

    @F.arrow_udf("bigint")
    def n(column: pa.Array) -> pa.Array:
        a = compiled(vocab.value)
        return pa.array([len(a.ids(t)) for t in texts(column)], pa.int64())

    return n(text.cast("binary"))


def decode(ids: Column, vocab) -> Column:
    """string: the text that token ids spell; null for null."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        a = compiled(vocab.value)
        return pa.array([None if x is None else a.decode(x) for x in column.to_pylist()], pa.string())

    return text(ids)
