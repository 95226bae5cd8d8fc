"""Token counts of every prefix of a text.

A byte-pair encoding is decided by its neighbours alone: a token sequence is
the encoding of a string exactly if each adjacent pair of tokens is the
encoding of the two tokens' joint string. So the last token of every prefix can
be found from left to right, and with it the number of tokens of the prefix.
The table that comes out answers how many tokens a prefix has, where a text
must be cut to fit a budget, and whether it fits at all, without encoding again.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, map_text, whole

#: Entries of each memo of a worker: words, pairs of tokens, beginnings of words. A full memo starts anew.
#: characters of the longest word that is remembered
MEMO_LENGTH = 64
MEMO_WORDS, MEMO_PAIRS, MEMO_STATES = 400_000, 600_000, 100_000
#: Length of the beginnings whose tables words share.
SHARED = 6
SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary"

# fixed values: the letters and digits below U+0180, for which Python and the library agree
LETTERS = "a-zªµºß-öø-ſ"
DIGITS = "0-9²³¹¼½¾"
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞€]*")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+| ")
SPACE = re.compile(r"\s+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    kept = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTables(dict):
    """Word -> little-endian 16-bit steps of the token count, one for each code point of the word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or not spec["pre_tokenizer"]:
            raise ValueError("a word-level BPE model is needed")
        self.lib = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.follow: dict[str, dict[str, int]] = {}
        for p, i in self.rank.items():
            self.parts.setdefault(p[0] + p[1], p)
            self.follow.setdefault(p[0], {})[p[1]] = i
        self.spines: tuple[dict, dict] = ({}, {})
        self.vocab = model["vocab"]
        self.ending = {t[: len(t) - len(self.end)] for t in self.vocab if t.endswith(self.end)}
        self.inner = {t for t in self.vocab if not self.end or not t.endswith(self.end)}
        self.longest = max(map(len, self.ending | self.inner))
        self.states: dict[str, tuple[list[str], list[int], list[int]]] = {}
        self.letters = byte_letters()
        self.agree: dict[tuple[str, str], bool] = {}
        self.specials = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")") if spec["added_tokens"] else None

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, for the short strings of two tokens."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one edge of `token` while it is built, each with the rank of the merge that ends it."""
        found, ends = [], 1 << 60
        while True:
            found.append((token, ends))
            if (parts := self.parts.get(token)) is None:
                return found
            ends, token = self.rank[parts], parts[side]

    def pair(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when their joint string is encoded.

        A merge across the border comes about if its rank is below that of the
        merge which takes its left part away, and not above that of the one
        which takes its right part: of equal merges the leftmost goes first.
        """
        key = (left, right)
        if (known := self.agree.get(key)) is None:
            if len(self.agree) > MEMO_PAIRS:
                self.agree.clear()
            if (x := self.spines[1].get(left)) is None:
                x = self.spines[1][left] = self.spine(left, 1)
            if (y := self.spines[0].get(right)) is None:
                y = self.spines[0][right] = self.spine(right, 0)
            known = True
            for a, a_ends in x:
                if (follow := self.follow.get(a)) is not None:
                    for b, b_ends in y:
                        if (r := follow.get(b)) is not None and r < a_ends and r <= b_ends:
                            known = False
            self.agree[key] = known
        return known

    def extend(self, s: str, last: list[str], count: list[int], full: list[int]) -> None:
        """Carries the three tables from the prefixes they cover on to the whole of s.

        last and count: the last token and the number of tokens of each prefix
        that goes on; full: the tokens of the prefix as a word of its own.
        """
        inner, ending, end, pair, known = self.inner, self.ending, self.end, self.pair, self.agree
        for i in range(len(last), len(s) + 1):
            mid = fin = 0
            for j in range(max(0, i - self.longest), i):
                token, before = s[j:i], last[j]
                if j and not before:
                    continue
                if not mid and token in inner:
                    fits = j == 0 or known.get((before, token))
                    if pair(before, token) if fits is None else fits:
                        mid, mid_token = count[j] + 1, token
                        if fin:
                            break
                if not fin and token in ending:
                    fits = j == 0 or known.get((before, token + end))
                    if pair(before, token + end) if fits is None else fits:
                        fin = count[j] + 1
                        if mid:
                            break
            last.append(mid_token if mid else "")
            count.append(mid)
            full.append(fin or len(self.merged(self.symbols(s[:i] + end))))

    def state(self, s: str) -> tuple[list[str], list[int], list[int]]:
        """The tables of a short beginning, which many words share."""
        if (known := self.states.get(s)) is None:
            if len(self.states) > MEMO_STATES:
                self.states.clear()
            known = tuple(map(list.copy, self.state(s[:-1]))) if s else ([""], [0], [0])
            self.extend(s, *known)
            self.states[s] = known
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of word[:i] as a text of its own, for each i from 1 on."""
        raw = word.encode("utf-8")
        s = "".join(map(self.letters.__getitem__, raw))
        last, count, full = map(list.copy, self.state(s[:SHARED]))
        self.extend(s, last, count, full)
        if len(raw) == len(word):
            return full[1:]
        return [full[e] for e in accumulate(len(c.encode("utf-8")) for c in word)]

    def clear(self) -> None:
        super().clear()
        self.agree.clear()
        self.states.clear()

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO_WORDS:
            super().clear()
        if word == " ":
            made = bytes(2)
        else:
            counts = self.prefix_counts(word)
            made = array("h", map(int.__sub__, counts, [0, *counts[:-1]])).tobytes()
        if len(word) <= MEMO_LENGTH:
            self[word] = made
        return made

    def segment(self, text: str) -> bytes:
        """The steps over one stretch without special tokens, on its normal form."""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, WORD.findall(SPACE.sub(" ", text).lower())))
        normal = self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text
        at, out = 0, []
        for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(normal):
            if a > at:
                out.append(bytes(2 * (a - at)))
            if b > a:
                out.append(self[normal[a:b]])
            at = max(at, b)
        out.append(bytes(2 * max(0, len(normal) - at)))
        return b"".join(out)

    def steps(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self.segment(text)
        one = np.int16(1).tobytes()
        parts = self.specials.split(text)
        return b"".join(chain.from_iterable((self.segment(p),) if k % 2 == 0 else (bytes(2 * (len(p) - 1)), one) for k, p in enumerate(parts)))


@cache
def word_tables(path: str) -> WordTables:
    return WordTables(path)


def prefix_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_deltas of every row.

    prefix_deltas holds 16-bit little-endian steps: the running sum of the first
    i of them is the token count of the first i code points of the text's normal
    form (special strings count when complete). Null texts are empty texts;
    repeated rows give repeated rows; other columns are left out. The table of a
    text is made in the task that reads it, so memory follows the longest text.
    """

    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        tables = word_tables(tokenizer)
        claim(tables)
        texts = cut.column(1).to_pylist()
        steps = [tables.steps(t) for t in texts]
        tokens = [int(np.frombuffer(s, dtype="<i2").sum(dtype=np.int64)) for s in steps]
        n_bytes = pc.binary_length(cut.column(1)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([cut.column(0), n_bytes, pa.array(tokens, type=pa.int64()), pa.array(steps, type=pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"])

    return map_text(df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")), ["doc_id", "text"], each, SCHEMA)


def _counts(deltas: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas or b"", dtype="<i2"), dtype=np.int64)


def longest_prefix(deltas: str | Column, budget: int) -> Column:
    """Code points of the longest prefix that has at most `budget` tokens."""

    @F.pandas_udf("long")
    def cut(column):
        return column.map(lambda d: int(np.flatnonzero(np.r_[0, _counts(d)] <= budget)[-1]) if budget >= 0 else 0)

    return cut(deltas)


def tokens_at(deltas: str | Column, length: str | Column) -> Column:
    """Tokens of the prefix with `length` code points; lengths outside the text are moved to its ends."""
    import pandas as pd

    @F.pandas_udf("long")
    def at(column, lengths):
        made = []
        for d, n in zip(column, lengths, strict=True):
            counts = np.r_[0, _counts(d)]
            made.append(int(counts[min(max(int(n), 0), len(counts) - 1)]))
        return pd.Series(made, dtype="int64")

    return at(deltas, length)
