"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

A cut is a position between tokens. Its successor is the next cut: of the positions within ``size`` tokens of
the next piece's start (``overlap`` tokens before the cut), the last end of a paragraph, else of a line, of a
sentence, of a word, as far as one lies in the second half of the window; else the last such end of any kind
in the window; else the last end of a character. The successors of all positions of all texts of a batch are
one array; squaring it (each position jumps to its successor's successor) while collecting what is reached
from the starts gives all cuts in about log2 of the pieces' number rounds, none of them sequential in a text.

A piece never begins or ends within a character. Where characters take several tokens, positions whose overlap
would begin within one are passed over; only if a window has no other position, the overlap is longer by the
few tokens that complete the character.

Defined cases: null, empty and small texts give one piece (of null text: none), whole; a text without any
boundary is cut by characters; pieces join to the text when overlaps are left out, byte for byte, except for
bytes that aren't UTF-8, which are read as U+FFFD. All other columns of the input are kept; one named like an
output column is refused.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokenizer import TokenAutomaton, compiled, texts

PARAGRAPH = re.compile(rb"\n[ \t\r]*\n[ \t\r\n]*")
SENTENCE = re.compile("[.!?]+[\"')\\]]*(?=\\s)|(?:。|！|？)+(?:」|』|”)*".encode())
KINDS = ["character", "word", "sentence", "line", "paragraph", "end"]
PIECE = "array<struct<piece: int, first: int, tokens: int, boundary: string, piece_text: string>>"


def levels(text: bytes) -> np.ndarray:
    """For each byte position: 4 end of a paragraph, 3 line, 2 sentence, 1 word, 0 character, -1 within one."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(len(b) + 1, np.int8)
    out[:-1][(b & 0xC0) == 0x80] = -1
    blank = np.isin(b, (9, 10, 11, 12, 13, 32))
    out[1:-1][blank[1:] & ~blank[:-1]] = 1
    out[1:-1][~blank[1:] & blank[:-1]] = 1
    for m in SENTENCE.finditer(text):
        out[m.end()] = 2
    out[1:][b == 10] = 3
    for m in PARAGRAPH.finditer(text):
        out[m.end()] = 4
    return out


def successors(level: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(next cut, first token of the piece that begins at the cut) of each position 0..n of a text; n's next is n."""
    n = len(level) - 1
    at = np.arange(n + 1)
    whole = np.maximum.accumulate(np.where(level >= 0, at, 0))
    first = np.where(at == 0, 0, whole[np.maximum(at - overlap, 0)])
    even = level[np.maximum(at - overlap, 0)] >= 0  # the overlap begins at a character
    far = np.minimum(first + size, n)
    nxt = np.zeros(n + 1, np.int64)
    least = np.maximum(at, overlap)  # a piece is longer than what it shares
    half = np.maximum(least, first + size // 2)

    def choose(ok: np.ndarray, above: np.ndarray) -> None:
        last = np.maximum.accumulate(np.where(ok, at, 0))[far]
        take = (nxt == 0) & (last > above)
        nxt[take] = last[take]

    for k in (4, 3, 2, 1):
        choose((level >= k) & even, half)
    choose((level >= 1) & even, least)
    choose((level >= 0) & even, least)
    choose(level >= 0, least)
    choose(level >= -1, at)
    nxt[far == n] = n
    return nxt, first


def reached(nxt: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mask of the positions on the chains from starts, by squaring the successor table."""
    mask, jump = np.zeros(len(nxt), bool), nxt
    mask[starts] = True
    while True:
        mask[jump[np.flatnonzero(mask)]] = True
        twice = jump[jump]
        if (twice == jump).all():
            return mask
        jump = twice


def cut_batch(automaton: TokenAutomaton, batch: list[str], size: int, overlap: int) -> list[list[dict]]:
    """The pieces of each text."""
    out: list[list[dict]] = [[] for _ in batch]
    nexts, firsts, bases, docs, base = [], [], [], [], 0
    for i, text in enumerate(batch):
        ids = automaton.ids(text)
        if len(ids) <= size:
            out[i] = [{"piece": 0, "first": 0, "tokens": len(ids), "boundary": "end", "piece_text": text}]
            continue
        raw = text.encode("utf-8", "replace")
        ends = np.append(0, np.cumsum(automaton.bytes_of[ids]))
        level = levels(raw)[ends]
        nxt, first = successors(level, size, overlap)
        nexts.append(nxt + base)
        firsts.append(first)
        bases.append(base)
        docs.append((i, raw, ends, level))
        base += len(nxt)
    if docs:
        mask = reached(np.concatenate(nexts), np.array(bases))
        for (i, raw, ends, level), first, b in zip(docs, firsts, bases, strict=True):
            cuts = np.flatnonzero(mask[b : b + len(ends)])
            for k, (start, end) in enumerate(zip(first[cuts[:-1]], cuts[1:], strict=True)):
                out[i].append({"piece": k, "first": int(start), "tokens": int(end - start), "boundary": KINDS[5 if end == len(ends) - 1 else max(0, int(level[end]))], "piece_text": raw[ends[start] : ends[end]].decode("utf-8", "replace")})
    return out


def cut_texts(df: DataFrame, text: str, vocab, size: int = 512, overlap: int = 64) -> DataFrame:
    """A row a piece: df's columns and piece, first, tokens (its first token and their number), boundary (kind of its end), piece_text."""
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half the size")
    if clash := {"piece", "first", "tokens", "boundary", "piece_text"} & set(df.columns):
        raise ValueError(f"columns of the input are named like the output's: {sorted(clash)}")

    @F.arrow_udf(PIECE)
    def pieces(column: pa.Array) -> pa.Array:
        a = compiled(vocab.value)
        null, got = column.is_null().to_pylist(), cut_batch(a, texts(column), size, overlap)
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("first", pa.int32()), ("tokens", pa.int32()), ("boundary", pa.string()), ("piece_text", pa.string())]))
        return pa.array([[] if x else y for x, y in zip(null, got, strict=True)], kind)

    return df.select("*", F.inline(pieces(df[text].cast("binary"))))

