"""Removal of every long byte string that occurs more than once, by a hash-compared suffix sort.

Two suffixes are compared by their longest common extension, which a binary
search finds on polynomial hashes of prefixes, so a comparison takes a number of
steps that is logarithmic in the length. A mergesort of suffix heads with this
comparison brings equal heads together; heads that the hashes call equal are
compared byte by byte before anything is removed. Which suffixes can be
repeated at all, and which must meet, the anchors of `repeats` tell.

Suffixes around a hot anchor are parted by a longer stretch first: those of a
block of neighbouring starts by the bytes that all of the block's windows share.
Where even that stretch stands in too many places to be sorted in one task, its
windows go on by themselves, named by 128 bits of two polynomial hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, cut_lineage, mix64
from .repeats import ANSWER, MESSAGE, NO_ID, SALT, Prefix, Units, answer_table, answers, blocks, by_group, message_table, near, ordered, repeated_anchors, salted, sliced

#: bytes of a string that is removed, of a shorter one that is only told of, and of an anchor
WINDOW, NOTE, GRAM = 400, 256, 32
#: bytes of suffix heads that a group sorts at a time; heads of one key stay together
CHUNK = 512 << 10
#: window starts of a block around a hot anchor, and heads of one key that are sorted
STARTS, MOST = 64, 512
#: suffix heads side by side: hash of the key, row and byte of the first, number of starts, place of the anchor (or of the block's first start) after it, bytes, whether all are known to be repeated, whether the anchor is hot
HEAD = np.dtype([("hash", "<u8"), ("row", "<u4"), ("at", "<u4"), ("n", "<u2"), ("off", "<u2"), ("size", "<u2"), ("sure", "u1"), ("hot", "u1")])
#: starts low to high of strings that are repeated, to the full length or to that of a note
SPAN = np.dtype([("row", "<u4"), ("low", "<u4"), ("high", "<u4"), ("full", "u1")])
#: a window by itself: two hashes, where it is, its length's kind, whether it is known to be repeated
ALONE = np.dtype([("hash", "<u8"), ("check", "<u8"), ("slice", "<u4"), ("row", "<u4"), ("at", "<u4"), ("full", "u1"), ("sure", "u1")])

BYTES = np.random.default_rng(20).integers(1, 1 << 63, 257, dtype=np.uint64)
#: stands behind the end of a document
END = 256
SECOND = 0xD1342543DE82EF95


def byte_values(text: bytes) -> np.ndarray:
    """A 64-bit value for each byte."""
    claim(None)
    return BYTES[np.frombuffer(text, dtype=np.uint8)]


def as_it_is(text: bytes) -> bytes:
    return text


UNITS = Units(as_it_is, byte_values)


class SuffixOrder:
    """Order of suffix heads of `depth` bytes in a buffer that holds them whole."""

    def __init__(self, buffer: np.ndarray, prefix: Prefix, depth: int):
        self.buffer, self.depth = buffer, depth
        self.sums, self.down = prefix.sums, prefix.down

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        s, d = self.sums, self.down
        return (s[a + size] - s[a]) * d[a] == (s[b + size] - s[b]) * d[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, at most the depth, by binary search."""
        out = np.full(len(a), self.depth, dtype=np.int64)
        todo = np.flatnonzero(~self.same(a, b, self.depth))
        low, high = np.zeros(len(todo), dtype=np.int64), np.full(len(todo), self.depth - 1, dtype=np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(a[todo], b[todo], middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        out[todo] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a's head sorts before b's, and whether they are equal."""
        size = self.common(a, b)
        equal = size == self.depth
        step = np.where(equal, 0, size)
        return ~equal & (self.buffer[a + step] < self.buffer[b + step]), equal

    def sort(self, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges runs of doubling width inside each group.

        Returns the places of `starts` in order, the group of each, and the
        common extension with the one before (0 where a group begins).
        """
        order = np.argsort(group, kind="stable")
        own = group[order]
        head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[head, len(own)])
        begin, end = np.repeat(head, size), np.repeat(head + size, size)
        local = np.arange(len(own)) - begin
        width, widest = 1, int(size.max()) if len(size) else 0
        while width < widest:
            run = local // width
            sibling = begin + (run ^ 1) * width
            low = np.minimum(sibling, end)
            high = np.minimum(sibling + width, end)
            left = (run & 1) == 0
            first = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                before, equal = self.less(starts[order[middle]], starts[order[todo]])
                before |= equal & ~left[todo]  # of equal heads those of the left run stay in front
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            target = begin + (run & ~1) * width + local % width + (low - first)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        shared = np.zeros(len(order), dtype=np.int64)
        follow = np.flatnonzero(own[1:] == own[:-1]) + 1
        shared[follow] = self.common(starts[order[follow - 1]], starts[order[follow]])
        return order, own, shared


def pack(heads: np.ndarray, raw: list[bytes]) -> bytes:
    return b"".join([len(heads).to_bytes(4, "little"), heads.tobytes(), *raw])


def unpack(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(data[:4], "little")
    heads = np.frombuffer(data, dtype=HEAD, count=n, offset=4).copy()
    ends = (np.cumsum(heads["size"].astype(np.int64)) + 4 + n * HEAD.itemsize).tolist()
    return heads, [data[a:z] for a, z in zip([4 + n * HEAD.itemsize, *ends], ends, strict=False)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def kinds_of(heads: np.ndarray, raw: list[bytes], span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which heads are equal as a whole, and the first of each kind; equal hashes are followed by a look at the bytes."""
    order = np.lexsort((heads["size"], heads["off"], heads["n"], span, heads["hash"]))
    new = np.ones(len(heads), dtype=bool)
    a, b = order[1:], order[:-1]
    new[1:] = (heads["hash"][a] != heads["hash"][b]) | (span[a] != span[b])
    for name in ("n", "off", "size"):
        new[1:] |= heads[name][a] != heads[name][b]
    for k in np.flatnonzero(~new).tolist():
        if raw[order[k]] != raw[order[k - 1]]:
            new[k] = True
    kind = np.empty(len(heads), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new]


class Heads:
    """Suffix heads in one buffer, each followed by the end sign up to the full depth of its last start."""

    def __init__(self, heads: np.ndarray, raw: list[bytes], depth: int):
        self.heads, self.raw, self.depth = heads, raw, depth
        size, n = heads["size"].astype(np.int64), heads["n"].astype(np.int64)
        room = n + depth - 1
        self.base = np.cumsum(room) - room
        self.buffer = np.full(int(room.sum()), END, dtype=np.uint16)
        here = np.repeat(self.base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.buffer[here] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.prefix = Prefix(BYTES[self.buffer])
        self.span = self.prefix.at(self.base, size)

    def starts(self, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place in `model`, the step within the head, and the bytes that remain, of every start."""
        count = self.heads["n"][model].astype(np.int64)
        of = np.repeat(np.arange(len(model)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, step, self.heads["size"][model].astype(np.int64)[of] - step


def resolve(heads: np.ndarray, raw: list[bytes], window: int, note: int) -> list[np.ndarray]:
    """For each head, the length (0, note or window) to which each of its starts is repeated; heads of one key are all here."""
    all_ = Heads(heads, raw, window)
    kind, model = kinds_of(heads, raw, all_.span)
    weight = np.bincount(kind) + np.bincount(kind, weights=heads["sure"]).astype(np.int64)
    of, step, rest = all_.starts(model)
    _, key = np.unique(heads["hash"][model], return_inverse=True)
    group = key[of] * 4096 + (heads["off"][model][of].astype(np.int64) - step + 1024)
    _, place, size = np.unique(group, return_inverse=True, return_counts=True)
    single = np.bincount(place, weights=weight[of] < 2)
    some = np.flatnonzero((size[place] > 1) & (single[place] > 0))
    starts = all_.base[model][of[some]] + step[some]
    sorted_, _, shared = SuffixOrder(all_.buffer, all_.prefix, window).sort(starts, group[some])
    reach = np.where(weight[of] >= 2, np.minimum(rest, window), 0)
    again = np.flatnonzero(shared >= note)
    one, two = some[sorted_[again - 1]], some[sorted_[again]]
    x, y = starts[sorted_[again - 1]], starts[sorted_[again]]
    common = np.minimum(np.minimum(shared[again], rest[one]), rest[two])
    # neighbouring pairs that run in step are one comparison of bytes
    by = np.lexsort((y, y - x))
    cut = np.flatnonzero(np.r_[True, (np.diff(y[by]) != 1) | (np.diff((y - x)[by]) != 0)][: len(by)])
    buffer = all_.buffer
    for i, j in zip(cut, np.r_[cut[1:], len(by)][: len(cut)], strict=True):
        p, q = int(x[by[i]]), int(y[by[i]])
        long = int((y[by[i:j]] + common[by[i:j]]).max()) - q
        if not np.array_equal(buffer[p : p + long], buffer[q : q + long]):
            for k in by[i:j]:
                p, q, long = int(x[k]), int(y[k]), int(common[k])
                if not np.array_equal(buffer[p : p + long], buffer[q : q + long]):
                    common[k] = 0
    np.maximum.at(reach, one, common)
    np.maximum.at(reach, two, common)
    level = np.where(reach >= window, window, np.where(reach >= note, note, 0))
    count = heads["n"][model].astype(np.int64)
    first = np.cumsum(count) - count
    return [level[first[k] : first[k] + count[k]] for k in kind]


def alone(heads: np.ndarray, raw: list[bytes], own: np.ndarray, window: int, note: int) -> tuple[list[tuple[int, tuple]], np.ndarray]:
    """Windows of heads by themselves: the spans already known to be repeated here, by slice, and one of each window to send on."""
    known: list[tuple[int, tuple]] = []
    sent = []
    for a in range(0, len(heads), 1024):
        part = heads[a : a + 1024]
        all_ = Heads(part, raw[a : a + 1024], window)
        second = Prefix(BYTES[all_.buffer], SECOND)
        of, step, rest = all_.starts(np.arange(len(part)))
        for size in (note, window):
            some = rest >= size
            at = all_.base[of[some]] + step[some]
            made = np.zeros(len(at), dtype=ALONE)
            made["hash"], made["check"] = all_.prefix.at(at, size), second.at(at, size)
            made["slice"], made["row"], made["at"] = own[a:][of[some]], part["row"][of[some]], part["at"][of[some]] + step[some]
            made["full"], made["sure"] = size == window, part["sure"][of[some]]
            sent.append(made)
    every = np.concatenate(sent) if sent else np.zeros(0, dtype=ALONE)
    return known + told_alone(every), once(every)


def _same(every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal windows together, where each kind begins in it, and the kind of each place."""
    order = np.lexsort((every["check"], every["hash"], every["full"]))
    e = every[order]
    new = np.r_[True, (e["hash"][1:] != e["hash"][:-1]) | (e["check"][1:] != e["check"][:-1]) | (e["full"][1:] != e["full"][:-1])][: len(e)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def told_alone(every: np.ndarray) -> list[tuple[int, tuple]]:
    """(slice, span) of the windows that occur again among these and are not known yet."""
    order, begin, kind = _same(every)
    e = every[order]
    e = e[(np.bincount(kind)[kind] > 1) & (e["sure"] == 0)] if len(e) else e
    e = e[np.lexsort((e["at"], e["row"], e["slice"], e["full"]))]
    if not len(e):
        return []
    cut = (e["full"][1:] != e["full"][:-1]) | (e["slice"][1:] != e["slice"][:-1]) | (e["row"][1:] != e["row"][:-1]) | (e["at"][1:] > e["at"][:-1] + 1)
    low, high = np.flatnonzero(np.r_[True, cut]), np.flatnonzero(np.r_[cut, True])
    return [(int(e["slice"][a]), (int(e["row"][a]), int(e["at"][a]), int(e["at"][z]), int(e["full"][a]))) for a, z in zip(low, high, strict=True)]


def once(every: np.ndarray) -> np.ndarray:
    """One of each window, known to be repeated if it is among these or any of them is."""
    order, begin, kind = _same(every)
    out = every[order[begin]].copy()
    if len(out):
        out["sure"] = (np.bincount(kind) > 1) | (np.maximum.reduceat(every["sure"][order], begin) > 0)
    return out


def covered(spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that strings of `size` bytes cover, from the spans of their starts."""
    if not len(spans):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    spans = spans[np.argsort(spans["low"], kind="stable")]
    low, end = spans["low"].astype(np.int64), np.maximum.accumulate(spans["high"].astype(np.int64) + size)
    first = np.flatnonzero(np.r_[True, low[1:] > end[:-1]])
    return low[first], end[np.r_[first[1:] - 1, len(low) - 1]]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, note: int = NOTE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_repeated and the bytes that stay.

    A byte goes if a string of `window` bytes that covers it starts anywhere else
    in the corpus too. n_repeated counts the bytes that a string of `note` bytes
    covers which starts anywhere else; they go only if a full string covers them
    too. Rows are documents of their own even where ids repeat, or are null; null
    texts are empty; other columns are left out. What stays is binary, as a
    string may begin or end inside a character. Texts longer than 1 MB are worked
    on in pieces, so a task's memory follows its slice of about 4 MB and the
    longest text, a few times over.
    """
    note = min(note, window)
    starts = min(STARTS, note // 2)
    rows, n_slices, groups = sliced(docs, id_col, text_col)
    salt = SALT if n_slices > SALT else 0
    hot = repeated_anchors(rows, groups, UNITS, note, gram, window)

    def send(key, table: pa.Table, told: pa.Table) -> pa.Table:
        own = key[0].as_py()
        texts = ordered(table)[2]
        known = np.unique(answers(told, np.uint64))
        heads, raws, spans = [], [], []
        for b in blocks(texts, UNITS, window) if len(known) else ():
            prefix = Prefix(b.values)
            found = b.anchors(prefix, note, gram)
            some, burning = near(found, known)
            for each, is_hot in ((some[~burning], 0), (some[burning], 1)):
                low, high, name, at = found.low[each], found.high[each], found.hash[each], found.at[each]
                off = at - low
                if is_hot:  # a block is the starts whose distance to the anchor is alike but for its last bits
                    parts = (at - low) // starts - (at - high) // starts + 1
                    of = np.repeat(np.arange(len(low)), parts)
                    block = ((at - low) // starts)[of] - (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
                    edge, at = at[of] - block * starts, at[of]  # the last start of the block
                    low, high = np.maximum(low[of], edge - starts + 1), np.minimum(high[of], edge)
                    name = mix64(mix64(name[of] + block.astype(np.uint64)) + prefix.at(edge, note - starts + 1))
                    off = edge - low
                row = np.searchsorted(b.offsets, low, side="right") - 1
                end = np.minimum(high + window, b.offsets[row + 1])
                head = np.zeros(len(low), dtype=HEAD)
                head["hash"], head["row"], head["at"] = name, b.first + row, low - b.offsets[row] + b.base
                head["n"], head["off"], head["size"], head["hot"] = high - low + 1, off, end - low, is_hot
                heads.append(head)
                spans.append(prefix.at(low, end - low))
                begin = b.offsets[row]
                raws += [b.raw[r][a:z] for r, a, z in zip(row.tolist(), (low - begin).tolist(), (end - begin).tolist(), strict=True)]
        if not heads:
            return message_table([])
        head, span = np.concatenate(heads), np.concatenate(spans)
        kind, first = kinds_of(head, raws, span)
        many = np.bincount(kind) > 1
        head["sure"][first] = many
        one = head[first]
        sent = [(g, own, pack(one[part], [raws[first[k]] for k in part])) for g, part in by_group(np.where(one["hot"] > 0, salted(one["hash"], own, salt), one["hash"]), groups)]
        sure = np.flatnonzero(many[kind])
        if len(sure):  # equal heads of a slice are compared here, and one of them stands for all in the sort
            certain = _spans(head[sure], window)
            sent.append((own % groups, -1 - own, certain.tobytes()))
        return message_table(sent)

    def sort_group(table: pa.Table) -> pa.Table:
        out, heads, slices, raws = [], [], [], []
        for own, data in zip(table.column("slice").to_pylist(), table.column("data"), strict=True):
            if own < 0:
                out.append((-1 - own, data.as_py()))
                continue
            head, raw = unpack(data.as_py())
            heads.append(head)
            slices.append(np.full(len(head), own, dtype=np.int64))
            raws += raw
        if heads:
            head, own = np.concatenate(heads), np.concatenate(slices)
            order = np.argsort(head["hash"], kind="stable")
            _, first, count = np.unique(head["hash"][order], return_index=True, return_counts=True)
            burning = head["hot"][order[first]] > 0
            apart = burning & ((count > MOST) | (salt > 0))
            told: dict[int, list] = {}
            todo: list[int] = []
            size = 0
            some = np.flatnonzero((count > 1) & ~apart)
            for n, (f, c) in enumerate(zip(first[some].tolist(), count[some].tolist(), strict=True)):
                members = order[f : f + c].tolist()
                todo += members
                size += sum(len(raws[k]) for k in members)
                if size >= CHUNK or n == len(some) - 1:
                    for k, level in zip(todo, resolve(head[todo], [raws[k] for k in todo], window, note), strict=True):
                        if not head["sure"][k]:
                            at, row = int(head["at"][k]), int(head["row"][k])
                            told.setdefault(int(own[k]), []).extend([(row, at + a, at + z, 0) for a, z in _runs(level >= note)] + [(row, at + a, at + z, 1) for a, z in _runs(level >= window)])
                    todo, size = [], 0
            for f, c in zip(first[apart].tolist(), count[apart].tolist(), strict=True):
                members = order[f : f + c]
                known, on = alone(head[members], [raws[k] for k in members], own[members], window, note)
                for s, span in known:
                    told.setdefault(s, []).append(span)
                if salt:  # the same windows may stand in other salted groups
                    out += [(-1 - g, on[part].tobytes()) for g, part in by_group(on["hash"], groups)]
            out += [(s, np.array(spans, dtype=SPAN).tobytes()) for s, spans in told.items() if spans]
        return answer_table(out)

    def meet(table: pa.Table) -> pa.Table:
        told: dict[int, list] = {}
        for s, span in told_alone(answers(table, ALONE)):
            told.setdefault(s, []).append(span)
        return answer_table([(s, np.array(spans, dtype=SPAN).tobytes()) for s, spans in told.items()])

    def cut(key, table: pa.Table, told: pa.Table) -> pa.Table:
        ids, _, texts = ordered(table)
        spans = answers(told, SPAN)
        spans = spans[np.argsort(spans["row"], kind="stable")]
        begin = np.searchsorted(spans["row"], np.arange(len(texts) + 1))
        n_bytes, n_removed, n_spans, n_repeated, kept = [], [], [], [], []
        for i, text in enumerate(texts):
            own = spans[begin[i] : begin[i + 1]]
            low, end = covered(own[own["full"] == 1], window)
            n_bytes.append(len(text))
            n_removed.append(int((end - low).sum()))
            n_spans.append(len(low))
            kept.append(b"".join(text[a:z] for a, z in zip([0, *end.tolist()], [*low.tolist(), len(text)], strict=True)) if len(low) else text)
            low, end = covered(own[own["full"] == 0], note)
            n_repeated.append(int((end - low).sum()))
        doc = pa.array(ids, mask=ids == NO_ID)
        return pa.table([doc, *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans, n_repeated)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"])

    parts = rows.groupBy("slice")
    told = parts.cogroup(hot.groupBy("slice")).applyInArrow(send, MESSAGE).groupBy("group").applyInArrow(sort_group, ANSWER)
    if salt:
        told = cut_lineage(told)
        told = told.filter("slice >= 0").union(told.filter("slice < 0").groupBy("slice").applyInArrow(meet, ANSWER))
    return parts.cogroup(told.groupBy("slice")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")


def _spans(heads: np.ndarray, window: int) -> np.ndarray:
    """Spans of heads all of whose starts are known to be repeated as far as the head goes."""
    notes = np.zeros(len(heads), dtype=SPAN)
    notes["row"], notes["low"], notes["high"] = heads["row"], heads["at"], heads["at"] + heads["n"] - 1
    full = heads[heads["size"] >= window]
    whole = np.zeros(len(full), dtype=SPAN)
    whole["row"], whole["low"], whole["full"] = full["row"], full["at"], 1
    whole["high"] = full["at"] + np.minimum(full["n"], full["size"] - window + 1) - 1
    return np.concatenate([notes, whole])
