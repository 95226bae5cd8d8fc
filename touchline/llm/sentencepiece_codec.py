"""SentencePiece BPE encoding that keeps the place of every piece in the source, and decoding.

Normalisation walks the compiled character map for the longest entry at each
place and notes, for every character that it writes, the source byte at which it
began. Pieces are found on the normal form and projected through these notes
back to byte spans of the original text. A text is encoded in stretches between
which no piece of the vocabulary can reach; equal stretches are encoded once.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, list_array, map_text, whole

#: Stretches whose pieces a worker keeps; a full memo starts anew.
#: characters of the longest stretch that is remembered
MEMO_LENGTH = 64
MEMO = 200_000
SPACE = "▁"
NONE = float("-inf")
SCHEMA = "doc_id long, ids array<int>, ends array<int>"
# fixed values of the model format
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift, more = at + 1, shift + 7, data[at] & 128
        if not more:
            return value, at


def _fields(data: bytes):
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8 and the strings it leads to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest entry that begins at data[at] and its replacement."""
        units, found = self.units, None
        if not units:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & 512) >> 6)

        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)].decode("utf-8")


class Codec:
    """A model file's vocabulary, its normaliser, and memos of encoded stretches."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24) or not normalizer.get(5, 1):
            raise ValueError("a BPE model without user-defined or unused pieces is needed")
        texts = [p[1].decode("utf-8") for p in pieces]
        self.kinds, self.texts = kinds, texts
        self.eos = texts.index(trainer.get(47, b"</s>").decode("utf-8"))
        self.unk = kinds.index(UNKNOWN)
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        self.score = {t: struct.unpack("<f", p.get(2, bytes(4)))[0] for t, k, p in zip(texts, kinds, pieces, strict=True) if k == NORMAL}
        self.index = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE} if trainer.get(35) else {}
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        joined = [t for t in self.score if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in joined):
            self.stretch = re.compile(".+", re.DOTALL)
        else:
            inside = set("".join(joined)) - {SPACE}
            kinds_inside = [{c for c in inside if c.isalpha()}, {c for c in inside if not c.isalpha()}]
            if any(len({c.isalpha() for c in t.lstrip(SPACE)}) > 1 for t in joined):
                kinds_inside = [inside]
            # no piece reaches from one class into the other, or past a mark that follows anything else
            classes = ["".join(map(re.escape, sorted(k))) for k in kinds_inside if k]
            other = "".join(classes)
            self.stretch = re.compile("|".join([*(f"{SPACE}*[{k}]+" for k in classes), f"{SPACE}+", f"[^{other}{SPACE}]+"]))
        self.surface = [self.surface_of(t, k) for t, k in zip(texts, kinds, strict=True)]
        self.memo = StretchMemo(self)

    def surface_of(self, text: str, kind: int) -> str:
        if kind == BYTE:
            value = int(text[3:5], 16)
            return chr(value) if value < 128 else chr(0xDC00 + value)
        return {CONTROL: "", UNKNOWN: self.unk_surface}.get(kind, text.replace(SPACE, " "))

    # -- encoding

    def merged(self, s: str) -> list[str]:
        """Greedy merging: the best-scored adjacent pair first, of equals the leftmost."""
        score = self.score
        if len(s) <= 32:
            parts = list(s)
            scores = [score.get(both, NONE) for both in map(str.__add__, parts, parts[1:])]
            while scores and (best := max(scores)) != NONE:
                i = scores.index(best)
                parts[i] += parts.pop(i + 1)
                del scores[i]
                if i:
                    scores[i - 1] = score.get(parts[i - 1] + parts[i], NONE)
                if i < len(scores):
                    scores[i] = score.get(parts[i] + parts[i + 1], NONE)
            return parts
        parts, after, before = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (x := score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-x, i, both))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def pieces(self, s: str) -> tuple[list[int], list[str]]:
        """Ids of a stretch, and the normal text of each; of a character's byte pieces the last holds it."""
        ids, texts = [], []
        for part in self.merged(s):
            i = self.index.get(part)
            if i is not None:
                ids.append(i)
                texts.append(part)
            elif self.byte_id:
                raw = part.encode("utf-8")
                ids += [self.byte_id[b] for b in raw]
                texts += [""] * (len(raw) - 1) + [part]
            else:
                ids.append(self.unk)
                texts.append(part)
        return ids, texts

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normal form, and for each of its characters the source byte it came from, with the end last."""
        data = text.encode("utf-8")
        out: list[str] = []
        starts: list[int] = []
        at, spaced = 0, self.squeeze
        while at < len(data):
            if (hit := self.map.longest(data, at)) is not None:
                size, made = hit
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                made = data[at : at + size].decode("utf-8")
            for c in made:
                if c == " " and self.squeeze and spaced:
                    continue
                spaced = c == " "
                out.append(SPACE if c == " " else c)
                starts.append(at)
            at += size
        if self.squeeze:
            while out and out[-1] == SPACE:
                out.pop()
                starts.pop()
        if out and self.dummy:
            out.insert(0, SPACE)
            starts.insert(0, starts[0])
        return "".join(out), [*starts, len(data)]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of the whole text and the source byte at which each ends, as 32-bit integers."""
        if not text:
            return b"", b""
        memo = self.memo
        if not self.map.units and not self.squeeze and SPACE not in text:
            normal = text.replace(" ", SPACE)
            found = self.stretch.findall(SPACE + normal if self.dummy else normal)
            both = np.frombuffer(b"".join(map(memo.__getitem__, found)), dtype="<i4").reshape(-1, 2)
            ends = np.cumsum(both[:, 1], dtype=np.int32)
            return both[:, 0].tobytes(), (ends - 1 if self.dummy else ends).astype("<i4").tobytes()
        normal, starts = self.normalise(text)
        ids, ends, at = [], [], 0
        for s in self.stretch.findall(normal):
            more, texts = self.pieces(s)
            ids += more
            for size in accumulate(map(len, texts)):
                ends.append(starts[at + size])
            at += len(s)
        return np.array(ids, dtype="<i4").tobytes(), np.array(ends, dtype="<i4").tobytes()

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        surface, lead = self.surface, 0
        made = "".join(map(surface.__getitem__, ids.tolist()))
        if self.dummy or self.squeeze:
            for i in ids:
                kind = self.kinds[i]
                if kind == CONTROL:
                    continue
                if kind == NORMAL:
                    spaces = len(self.texts[i]) - len(self.texts[i].lstrip(SPACE))
                    lead += min(spaces, 1)
                    if self.squeeze and surface[i] == " ":
                        continue
                break
        made = made[lead:]
        try:
            return made.encode("utf-8", "surrogateescape").decode("utf-8")
        except UnicodeDecodeError:
            return "".join(_bytes_to_text(m) if k % 2 else m for k, m in enumerate(re.split("([\x00-\x7f\udc80-\udcff]+)", made)))


def _bytes_to_text(run: str) -> str:
    """Each valid character of a run of bytes, and a replacement mark for every byte outside one."""
    data, at, out = run.encode("utf-8", "surrogateescape"), 0, []
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class StretchMemo(dict):
    """Stretch -> 32-bit pairs of a piece's id and its source bytes, where each mark stands for one space."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, s: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        flat = array("i")
        for i, t in zip(*self.codec.pieces(s), strict=True):
            flat.append(i)
            flat.append(len(t.encode("utf-8")) - 2 * t.count(SPACE))
        made = flat.tobytes()
        if len(s) <= MEMO_LENGTH:
            self[s] = made
        return made


@cache
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """doc_id, ids, and ends: the byte of the UTF-8 text at which each piece ends, where the next begins.

    With decoded=True also the text that the ids decode to, in the same pass.

    An end id has the text's end. Null and empty texts have no pieces but the
    end id; repeated rows give repeated rows; columns other than `carry` are left
    out. One text is encoded at a time: a task holds about 60 bytes for each
    character of the longest stretch without a space, and 8 for each piece.
    """

    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        made = codec(model)
        claim(made.memo)
        tail = np.array([made.eos] if eos else [], dtype="<i4").tobytes()
        ids, ends, lengths = [], [], []
        for text in cut.column(1).to_pylist():
            a, b = made.encode(text)
            ids += (a, tail)
            ends += (b, (b[-4:] or bytes(4)) if tail else b"")
            lengths.append((len(a) + len(tail)) // 4)
        flat = [np.frombuffer(b"".join(x), dtype="<i4") for x in (ids, ends)]
        columns = [cut.column(0), *(list_array(x, np.array(lengths), pa.int32()) for x in flat)]
        if decoded:
            cuts = np.cumsum(lengths)[:-1]
            columns.append(pa.array([made.decode(x) for x in np.split(flat[0], cuts)] if lengths else [], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ends", "decoded"][: len(columns)])

    rows = df.select(F.col(id_col).cast("long").alias("__id"), whole(text_col).alias("__text"), *carry)
    return map_text(rows, ["__id", "__text"], each, SCHEMA + ", decoded string" * decoded, carry=carry)


def decode(ids: str | Column, model: str) -> Column:
    """The text of an id list; null lists have null texts."""

    @F.pandas_udf("string")
    def text_of(column):
        made = codec(model)
        return column.map(lambda x: None if x is None else made.decode(np.asarray(x, dtype=np.int64)))

    return text_of(ids)
