"""Removal of word windows that began earlier in the corpus, by suffix trees cut to a window's depth.

Suffixes that can be repeated (see repeats) are split into groups that fit a
task's memory by what they begin with around their anchor: the six words of the
anchor, or, where those stand in very many places, all words of a window. In a
group the suffixes that share such a prefix are a subtree: they are sorted by
their words, neighbours' common extensions give its internal nodes, and a node
as deep as a window is a repeat: all of its leaves but the earliest are covered.
Overlapping covered windows join into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, cut_lineage, mix64
from .repeats import ANSWER, MESSAGE, NO_ID, SALT, Prefix, Units, answer_table, answers, blocks, by_group, message_table, near, ordered, repeated_anchors, row_order, salted, sliced

WINDOW, GRAM = 20, 6
#: bytes of words whose hashes a worker remembers; longer words are not remembered
MEMO, MEMO_WORD = 16 << 20, 64
#: window starts that are sorted at a time; suffixes of one anchor stay together
CHUNK = 1 << 16
SECOND = 0xD1342543DE82EF95
#: suffixes side by side: hash of their anchor, document, order among rows of one id, row and word of the first, number of starts, place of the anchor, bytes of their words
HEAD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "<u2"), ("off", "<u2"), ("size", "<u4")])
#: a suffix of a hot anchor: two hashes of the words of its window, and where it is
LEAF = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("slice", "<u4"), ("row", "<u4"), ("at", "<u4")])
SPOT = np.dtype([("row", "<u4"), ("at", "<u4")])


class Words(dict):
    """64-bit hashes of words."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMO_WORD:
            self.size += len(word) + 64
            if self.size > MEMO:
                self.clear()
            self[word] = made
        return made

    def clear(self) -> None:
        super().clear()
        self.size = 0


WORDS = Words()


def split_words(text: bytes) -> list[bytes]:
    """The runs of bytes that are not ASCII white space."""
    return text.split()


def hash_words(words: Sequence[bytes]) -> np.ndarray:
    claim(WORDS)
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def word_values(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Hashes of the words of a text, and the words."""
    words = split_words(text)
    return hash_words(words), words


UNITS = Units(split_words, hash_words)


def later_leaves(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest leaf of each window, and all others."""
    order = np.lexsort((leaf["at"], leaf["row"], leaf["tie"], leaf["doc"], leaf["check"], leaf["hash"]))
    leaf = leaf[order]
    later = np.zeros(len(leaf), dtype=bool)
    later[1:] = (leaf["hash"][1:] == leaf["hash"][:-1]) & (leaf["check"][1:] == leaf["check"][:-1])
    return leaf[~later], leaf[later]


def subtrees(heads: np.ndarray, raw: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads (their places) and steps of the suffixes below a node of window depth that are not its earliest leaf."""
    early = np.lexsort((heads["at"], heads["row"], heads["tie"], heads["doc"]))
    names: dict[bytes, int] = {}
    words = [names.setdefault(w, len(names)) for k in early.tolist() for w in raw[k].split(b" ")]
    symbols = np.array(words, dtype=np.uint64)
    count = heads["n"][early].astype(np.int64)
    base = np.cumsum(count + window - 1) - (count + window - 1)
    of = np.repeat(np.arange(len(early)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = base[of] + step
    wide = max(1, len(names).bit_length())
    each = 63 // wide
    packed = []
    for a in range(0, window, each):
        column = np.zeros(len(start), dtype=np.uint64)
        for j in range(a, min(a + each, window)):
            column = (column << np.uint64(wide)) | symbols[start + j]
        packed.append(column)
    order = np.lexsort(packed[::-1])  # keeps the earliest first among equal ones
    common = np.zeros(len(order), dtype=np.int64)  # words shared with the neighbour before
    going = np.ones(max(0, len(order) - 1), dtype=bool)
    for j in range(window):
        column = symbols[start[order] + j]
        going &= column[1:] == column[:-1]
        common[1:] += going
    later = order[common == window]
    return early[of[later]], step[later]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, n_repeats, the kept words joined by one space, and the columns of `carry`.

    A word goes if a window of `window` words that covers it also starts earlier:
    in a smaller doc_id, or in the same document before. A null id comes before
    all others; of rows with one id the one whose text has the smaller hash is
    the earlier. Null texts have no words; other columns are left out. A task's
    memory follows its slice of about 4 MB and the longest text, whose words it
    holds as a list.
    """
    rows, n_slices, groups = sliced(docs, id_col, text_col, carry)
    salt = SALT if n_slices > SALT else 0
    hot = repeated_anchors(rows, groups, UNITS, window, gram, window)

    def send(key, table: pa.Table, told: pa.Table) -> pa.Table:
        own = key[0].as_py()
        ids, ties, texts = ordered(table)
        known = np.unique(answers(told, np.uint64))
        heads, raws, spans, leaves = [], [], [], []
        for b in blocks(texts, UNITS, window) if len(known) else ():
            prefix = Prefix(b.values)
            found = b.anchors(prefix, window, gram)
            some, burning = near(found, known)
            low, high = found.low[some], found.high[some]
            row = np.searchsorted(b.offsets, low, side="right") - 1
            count = high - low + 1
            head = np.zeros(len(some), dtype=HEAD)
            head["hash"], head["doc"], head["tie"] = found.hash[some], ids[b.first + row], ties[b.first + row]
            head["row"], head["at"], head["n"], head["off"] = b.first + row, low - b.offsets[row] + b.base, count, found.at[some] - low
            plain = np.flatnonzero(~burning)
            begin = b.offsets[row]
            words = [b" ".join(b.raw[r][a:z]) for r, a, z in zip(row[plain].tolist(), (low - begin)[plain].tolist(), (high - begin + window)[plain].tolist(), strict=True)]
            head["size"][plain] = [len(w) for w in words]
            heads.append(head[plain])
            raws += words
            spans.append(prefix.at(low[plain], (count + window - 1)[plain]))
            if burning.any():
                of = np.flatnonzero(burning)
                n = count[of]
                start = np.repeat(low[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                leaf = np.zeros(len(start), dtype=LEAF)
                leaf["hash"], leaf["check"], leaf["slice"] = prefix.at(start, window), Prefix(mix64(b.values), SECOND).at(start, window), own
                for name in ("doc", "tie", "row"):
                    leaf[name] = np.repeat(head[name][of], n)
                leaf["at"] = np.repeat(head["at"][of].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(len(start))
                leaves.append(leaf)
        if not heads:
            return message_table([])
        head, span = np.concatenate(heads), np.concatenate(spans)
        order = np.lexsort((head["at"], head["row"], head["tie"], head["doc"], head["n"], head["off"], span, head["hash"]))
        first, sure, last = [], [], None
        for k in order.tolist():  # of equal heads of a slice the earliest stands for all
            if last is not None and span[k] == span[last] and head["off"][k] == head["off"][last] and raws[k] == raws[last]:
                sure.append(k)
            else:
                last = k
                first.append(k)
        one = head[first]
        sent = [(g, own, b"H" + len(part).to_bytes(4, "little") + one[part].tobytes() + b"".join(raws[first[k]] for k in part)) for g, part in by_group(one["hash"], groups)]
        twice = head[sure]
        n = twice["n"].astype(np.int64)
        spots = np.zeros(int(n.sum()), dtype=SPOT)
        spots["row"], spots["at"] = np.repeat(twice["row"], n), np.repeat(twice["at"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(len(spots))
        if leaves:
            leaf, later = later_leaves(np.concatenate(leaves))
            sent += [(g, own, b"L" + leaf[part].tobytes()) for g, part in by_group(salted(leaf["hash"], own, salt), groups)]
            more = np.zeros(len(later), dtype=SPOT)
            more["row"], more["at"] = later["row"], later["at"]
            spots = np.concatenate([spots, more])
        if len(spots):  # certain already; the slice hears of them with the rest
            sent.append((own % groups, -1 - own, spots.tobytes()))
        return message_table(sent)

    def told_of(own: np.ndarray, rows_: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes]]:
        spots = np.zeros(len(own), dtype=SPOT)
        order = np.argsort(own, kind="stable")
        spots["row"], spots["at"] = rows_[order], at[order]
        names, begin = np.unique(own[order], return_index=True)
        return [(int(s), part.tobytes()) for s, part in zip(names, np.split(spots, begin[1:]), strict=True)] if len(own) else []

    def subtree(table: pa.Table) -> pa.Table:
        out, heads, slices, raws, leaves = [], [], [], [], []
        for own, cell in zip(table.column("slice").to_pylist(), table.column("data"), strict=True):
            data = cell.as_py()
            if own < 0:
                out.append((-1 - own, data))
            elif data[:1] == b"L":
                leaves.append(np.frombuffer(data, dtype=LEAF, offset=1))
            else:
                n = int.from_bytes(data[1:5], "little")
                head = np.frombuffer(data, dtype=HEAD, count=n, offset=5)
                ends = (np.cumsum(head["size"].astype(np.int64)) + 5 + n * HEAD.itemsize).tolist()
                raws += [data[a:z] for a, z in zip([5 + n * HEAD.itemsize, *ends], ends, strict=False)]
                heads.append(head)
                slices.append(np.full(n, own, dtype=np.int64))
        if heads:
            head, own = np.concatenate(heads), np.concatenate(slices)
            order = np.argsort(head["hash"], kind="stable")
            _, first, count = np.unique(head["hash"][order], return_index=True, return_counts=True)
            first, count = first[count > 1], count[count > 1]
            todo: list[int] = []
            size = 0
            for k, (f, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
                todo += order[f : f + c].tolist()
                size += int(head["n"][order[f : f + c]].sum())
                if size >= CHUNK or k == len(first) - 1:
                    some = np.array(todo)
                    place, step = subtrees(head[some], [raws[i] for i in todo], window)
                    out += told_of(own[some[place]], head["row"][some[place]], head["at"][some[place]] + step)
                    todo, size = [], 0
        if leaves:
            leaf, later = later_leaves(np.concatenate(leaves))
            out += told_of(later["slice"].astype(np.int64), later["row"], later["at"])
            if salt:  # the same windows may stand in other salted groups
                out += [(-1 - g, leaf[part].tobytes()) for g, part in by_group(leaf["hash"], groups)]
        return answer_table(out)

    def meet(table: pa.Table) -> pa.Table:
        _, later = later_leaves(answers(table, LEAF))
        return answer_table(told_of(later["slice"].astype(np.int64), later["row"], later["at"]))

    def cut(key, table: pa.Table, told: pa.Table) -> pa.Table:
        ids, _, texts, order = row_order(table)
        ids, texts = ids[order], [texts[i] for i in order]
        spots = answers(told, SPOT)
        spots = spots[np.lexsort((spots["at"], spots["row"]))]
        begin = np.searchsorted(spots["row"], np.arange(len(texts) + 1))
        n_words, n_removed, n_repeats, kept = [], [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            at = spots["at"][begin[i] : begin[i + 1]].astype(np.int64)
            if len(at):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                n_removed.append(int((~keep).sum()))
                n_repeats.append(int((np.diff(np.r_[True, keep].astype(np.int8)) == -1).sum()))
                kept.append(b" ".join(compress(words, keep.tolist())).decode("utf-8"))
            else:
                n_removed.append(0)
                n_repeats.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
            n_words.append(len(words))
        doc = pa.array(ids, mask=ids == NO_ID)
        made = pa.table([doc, *(pa.array(x, pa.int64()) for x in (n_words, n_removed, n_repeats)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "n_repeats", "kept"])
        for name in carry:
            made = made.append_column(name, table.column(f"carry_{name}").take(pa.array(order, pa.int64())))
        return made

    kinds = dict(docs.dtypes)
    parts = rows.groupBy("slice")
    covered = parts.cogroup(hot.groupBy("slice")).applyInArrow(send, MESSAGE).groupBy("group").applyInArrow(subtree, ANSWER)
    if salt:
        covered = cut_lineage(covered)
        covered = covered.filter("slice >= 0").union(covered.filter("slice < 0").groupBy("slice").applyInArrow(meet, ANSWER))
    return parts.cogroup(covered.groupBy("slice")).applyInArrow(cut, ", ".join(["doc_id long, n_words long, n_removed long, n_repeats long, kept string", *(f"`{c}` {kinds[c]}" for c in carry)]))

