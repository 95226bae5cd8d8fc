"""Finding repeated stretches of a corpus without shuffling every suffix.

Documents are dealt into slices that fit a task's memory. Each slice picks
anchors: in every window the short gram with the least hash, so that equal
windows hold the same anchor at the same place. Slices send the distinct hashes
of their anchors to groups; a group tells a slice which of them occur
again, in that slice or another, and how hot it is. Only windows around those
anchors can be repeated, and only they are sent on: to the group of their
anchor, or, if that anchor is hot, to the group of a longer stretch of their
own. One stretch is sent once by a slice however often it occurs there, and what
is still hot meets in salted groups first, each of which sends on what it has
once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, whole

BASE = 0xA24BAED4963EE407
#: UTF-8 bytes of a slice, of the block of it that is hashed at a time, and of the pieces of texts that are longer
SLICE, BLOCK, PIECE = 4 << 20, 256 << 10, 1 << 20
LEAST_SLICES = 48
#: occurrences in the corpus from which an anchor is hot, and slices that a salted group hears
HOT, SALT = 1024, 1024
NO_ID = -(1 << 63)


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, dtype=np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefix:
    """Polynomial hashes of all stretches of a sequence of 64-bit values, from the hashes of its prefixes."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        size = 1 << max(12, int(len(values)).bit_length())
        up, self.down = _powers(size, base)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """The hash of every stretch of `size` values."""
        n = max(0, len(self.sums) - size)
        return mix64((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])

    def at(self, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[starts + size] - self.sums[starts]) * self.down[starts])


def sliding(values: np.ndarray, size: int, best: Callable) -> np.ndarray:
    """best of every `size` neighbours, by doubling."""
    out, reach = values, 1
    while reach < size:
        step = min(reach, size - reach)
        out = best(out[:-step], out[step:])
        reach += step
    return out


@dataclass
class Anchors:
    """Places, hashes, and the first and last window start that each anchor answers for."""

    at: np.ndarray
    hash: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchors(prefix: Prefix, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """The anchors of all windows inside documents that stand side by side at `offsets`.

    A place is an anchor if its gram's hash is the least of a window; a window
    belongs to the leftmost of its least ones.
    """
    reach = window - gram + 1
    total = int(offsets[-1])
    empty = np.zeros(0, dtype=np.int64)
    if total < window:
        return Anchors(empty, empty.astype(np.uint64), empty, empty)
    h = prefix.all(gram) | np.uint64(1)
    least = sliding(h, reach, np.minimum)
    for end in offsets[1:-1]:  # windows that cross a border
        least[max(0, end - window + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * (reach - 1), dtype=np.uint64)
    padded[reach - 1 : reach - 1 + len(least)] = least
    at = np.flatnonzero(h == sliding(padded, reach, np.maximum))
    ha = h[at]
    before, after = np.full(len(at), -1, dtype=np.int64), np.full(len(at), total + window, dtype=np.int64)
    todo_b, todo_a, step = np.arange(1, len(at)), np.arange(len(at) - 1), 1
    while len(todo_b) or len(todo_a):
        todo_b = todo_b[todo_b >= step]
        todo_b = todo_b[at[todo_b] - at[todo_b - step] < reach]
        hit = ha[todo_b - step] <= ha[todo_b]
        before[todo_b[hit]] = at[todo_b[hit] - step]
        todo_b = todo_b[~hit]
        todo_a = todo_a[todo_a + step < len(at)]
        todo_a = todo_a[at[todo_a + step] - at[todo_a] < reach]
        hit = ha[todo_a + step] < ha[todo_a]
        after[todo_a[hit]] = at[todo_a[hit] + step]
        todo_a = todo_a[~hit]
        step += 1
    doc = np.searchsorted(offsets, at, side="right") - 1
    low = np.maximum(np.maximum(at - reach + 1, before + 1), offsets[doc])
    high = np.minimum(np.minimum(at, after - reach), offsets[doc + 1] - window)
    some = low <= high
    return Anchors(at[some], ha[some], low[some], high[some])


class Units(NamedTuple):
    """How a text is cut into the units of windows, and the 64-bit values of units; functions that tasks import."""

    split: Callable[[bytes], Sequence]
    values: Callable[[Sequence], np.ndarray]


@dataclass
class Block:
    """Documents of a slice that are worked on together, or a piece of a long one.

    The first row's number, the values, where rows begin, the units, the place
    of the first unit in its text, and how many window starts of a piece are its
    own (None: all).
    """

    first: int
    values: np.ndarray
    offsets: np.ndarray
    raw: list
    base: int = 0
    own: int | None = None

    def anchors(self, prefix: Prefix, window: int, gram: int) -> Anchors:
        found = anchors(prefix, self.offsets, window, gram)
        if self.own is None:
            return found
        some = found.low < self.own
        return Anchors(found.at[some], found.hash[some], found.low[some], np.minimum(found.high[some], self.own - 1))


def row_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """Ids, ties, texts, and the order of a slice's rows that holds whenever the slice is read."""
    ids = np.asarray(table.column("doc_id").fill_null(NO_ID), dtype=np.int64)
    ties = np.asarray(table.column("tie"), dtype=np.int64)
    texts = [t.encode("utf-8") for t in table.column("text").to_pylist()]
    return ids, ties, texts, sorted(range(len(texts)), key=lambda i: (ids[i], ties[i], texts[i]))


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, ties and texts of a slice in that order."""
    ids, ties, texts, order = row_order(table)
    return ids[order], ties[order], [texts[i] for i in order]


def blocks(texts: list[bytes], units: Units, reach: int) -> Iterator[Block]:
    """The texts in blocks; long ones in pieces that go `reach` - 1 units beyond the window starts of their own."""
    first, size, values, raw = 0, 0, [], []

    def made() -> Block:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        return Block(first, np.concatenate(values) if offsets[-1] else np.zeros(0, dtype=np.uint64), offsets, raw)

    for n, text in enumerate(texts):
        r = units.split(text)
        if len(text) > PIECE and len(r):
            if values:
                yield made()
            step = max(reach, PIECE * len(r) // len(text))
            for base in range(0, len(r), step):
                part = r[base : base + step + reach - 1]
                yield Block(n, units.values(part), np.array([0, len(part)], dtype=np.int64), [part], base, step)
            first, size, values, raw = n + 1, 0, [], []
            continue
        values.append(units.values(r))
        raw.append(r)
        size += len(text)
        if size >= BLOCK:
            yield made()
            first, size, values, raw = n + 1, 0, [], []
    if values:
        yield made()


def sliced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(slice, doc_id, tie, text) rows, and the numbers of slices and groups, which follow the bytes of text.

    Rows are dealt by id and text, so rows that share an id, or have none, are
    spread; `tie` orders them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_SLICES, math.ceil(total / SLICE))
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return rows.select(deal.alias("slice"), "doc_id", F.xxhash64("text").alias("tie"), "text", *(f"carry_{c}" for c in carry)), n, max(LEAST_SLICES, n // 2)


def by_group(h: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of h by group. The hashes of anchors are small, as they are minima, so bits are mixed once more."""
    group = ((mix64(h ^ np.uint64(BASE)) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(group[part[0]]), part


MESSAGE = "group int, slice int, data binary"
ANSWER = "slice int, data binary"


def message_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    group, own, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"group": pa.array(group, pa.int32()), "slice": pa.array(own, pa.int32()), "data": pa.array(data, pa.binary())})


def answer_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    own, data = zip(*rows, strict=True) if rows else ((), ())
    return pa.table({"slice": pa.array(own, pa.int32()), "data": pa.array(data, pa.binary())})


#: how often a slice has an anchor
SEEN = np.dtype([("hash", "<u8"), ("count", "<u4")])


def repeated_anchors(rows: DataFrame, groups: int, units: Units, window: int, gram: int, reach: int) -> DataFrame:
    """(slice, data): 64-bit hashes of the slice's anchors that occur at least twice in the corpus.

    The last bit is 0 for those that occur more than HOT times; the hash itself
    has it set.
    """

    def send(table: pa.Table) -> pa.Table:
        texts = ordered(table)[2]
        found = [b.anchors(Prefix(b.values), window, gram).hash for b in blocks(texts, units, reach)]
        h, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0))
        seen = np.zeros(len(h), dtype=SEEN)
        seen["hash"], seen["count"] = h, counts
        own = table.column("slice")[0].as_py()
        return message_table([(g, own, seen[part].tobytes()) for g, part in by_group(h, groups)])

    def answer(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(d, dtype=SEEN) for d in table.column("data").to_pylist()]
        seen = np.concatenate(data) if data else np.zeros(0, dtype=SEEN)
        _, place = np.unique(seen["hash"], return_inverse=True)
        total = np.bincount(place, weights=seen["count"])[place] if len(seen) else np.zeros(0)
        told = np.where(total > HOT, seen["hash"] & ~np.uint64(1), seen["hash"])
        slices = np.repeat(np.asarray(table.column("slice")), [len(d) for d in data])
        return answer_table([(int(s), told[(total > 1) & (slices == s)].tobytes()) for s in np.unique(slices[total > 1])])

    return rows.groupBy("slice").applyInArrow(send, MESSAGE).groupBy("group").applyInArrow(answer, ANSWER)


def near(found: Anchors, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors whose hash is among the told ones, and whether each is hot."""
    if not len(told) or not len(found.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    known = np.sort(told | np.uint64(1))
    some = np.flatnonzero(known[np.minimum(np.searchsorted(known, found.hash), len(known) - 1)] == found.hash)
    hot = np.sort(told[told & np.uint64(1) == 0] | np.uint64(1))
    if not len(hot):
        return some, np.zeros(len(some), dtype=bool)
    return some, hot[np.minimum(np.searchsorted(hot, found.hash[some]), len(hot) - 1)] == found.hash[some]


def answers(table: pa.Table, kind) -> np.ndarray:
    data = [np.frombuffer(d, dtype=kind) for d in table.column("data").to_pylist()]
    return np.concatenate(data) if data else np.zeros(0, dtype=kind)


def salted(h: np.ndarray, own: int, salt: int) -> np.ndarray:
    """Hashes to deal by: those of `salt` slices meet; with 0 those of all."""
    return mix64(h + np.uint64(own // salt + 1) * np.uint64(BASE)) if salt else h
