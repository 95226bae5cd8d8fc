"""Finds test items inside documents within an edit budget, by the pigeonhole principle.

An item with a budget of e edits is split into e + 1 pieces; whatever the edits
are, one piece is left whole. An automaton over all pieces reads each document
once; every exact hit points to a stretch of the document where the item would
have to be, and Myers' bit-parallel algorithm gives the edit distance there.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut_lineage, map_text, slices, whole

ERROR_RATE = 0.08
#: text of the items that one automaton takes; more items are read in several passes over the documents
ITEM_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, distance long, start long, end long"

Item = namedtuple("Item", "id text budget")


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def pieces(item: Item) -> list[tuple[int, str]]:
    """Start and text of budget + 1 pieces of nearly equal length."""
    n, size = item.budget + 1, len(item.text)
    cuts = [k * size // n for k in range(n + 1)]
    return [(a, item.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> list[int]:
    """Least edit distance between the pattern and any stretch of the text that ends at each character."""
    equal: dict[str, int] = {}
    for k, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << k
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for c in text:
        eq = equal.get(c, 0)
        diagonal = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        up = (minus << 1 & full) | (full & ~(diagonal | plus))
        down = plus & diagonal
        out.append(score)
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        claim(None)
        self.items = [Item(i, t, int(rate * len(t))) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for start, piece in pieces(item):
                where.setdefault(piece, []).append((k, start + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item id, distance, start and end of the best place of every item within its budget."""
        if not self.items:
            return []
        near: dict[int, list[int]] = {}
        for end, places in self.automaton.iter(text):
            for k, at in places:
                near.setdefault(k, []).append(end - at)
        found = []
        for k, begins in near.items():
            item = self.items[k]
            size, e = len(item.text), item.budget
            best, reach = None, None
            for begin in sorted(set(begins)):
                if reach is None or begin - e > reach[1]:
                    best = self.better(best, item, text, reach)
                    reach = (begin - e, begin + size + e)
                else:
                    reach = (reach[0], begin + size + e)
            best = self.better(best, item, text, reach)
            if best is not None:
                found.append((item.id, *best))
        return found

    def better(self, best, item: Item, text: str, reach):
        """The better of `best` and the first of the best places inside reach."""
        if reach is None or best is not None and best[0] == 0:
            return best
        low, high = max(0, reach[0]), min(len(text), reach[1])
        if (at := text.find(item.text, low, high)) >= 0:
            return 0, at, at + len(item.text)
        scores = myers(item.text, text[low:high])
        least = min(scores, default=item.budget + 1)
        if least > item.budget or best is not None and least >= best[0]:
            return best
        end = low + scores.index(least) + 1
        back = myers(item.text[::-1], text[max(0, end - len(item.text) - least) : end][::-1])
        return least, end - 1 - back.index(least), end


class Items:
    """Normalised items in blocks of bounded text, fetched one at a time; a block is what every task gets."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str):
        rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.rows, self.blocks = rows, -(-size // ITEM_BYTES)

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        deal = F.pmod(F.xxhash64("id", "text"), F.lit(max(self.blocks, 1)))
        for k in range(self.blocks):
            yield sorted({(r["id"], normal(r["text"])) for r in self.rows.filter(deal == k).collect()})


def find_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every item that a document holds within rate x length edits.

    Compared on lower case with single spaces; start and end count characters of
    that form. Items without text match nothing, null documents hold nothing,
    and a document that holds an item twice has the row of the closest place, of
    equally close ones the first. Equal item texts are items of their own, an
    item given twice is one. Repeated rows give repeated rows, a null doc_id
    stays null. Texts are read whole, one at a time. More items than one block
    holds are read in several passes, each of which is written before the next
    block is fetched.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))

    def pass_over(block: list[tuple[int, str]]) -> DataFrame:
        made: list[Matcher] = []

        def each(cut: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(block, rate))
            out = [(d, *hit) for d, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True) for hit in made[0].find(normal(text))]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "end"])

        return map_text(rows, ["doc_id", "text"], each, SCHEMA)

    blocks = Items(items, item_col, item_text_col)
    parts = [cut_lineage(pass_over(b)) if len(blocks) > 1 else pass_over(b) for b in blocks]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], SCHEMA)


def without_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item within rate x length edits; null texts stay."""
    kept, place = docs, docs.columns.index(text_col)

    def pass_over(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        made: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not made:
                    made.append(Matcher(block, rate))
                for cut in slices(batch, place):
                    clean = [not made[0].find(normal(text or "")) for text in cut.column(place).to_pylist()]
                    yield cut.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    blocks = Items(items, item_col, item_text_col)
    for block in blocks:
        kept = pass_over(kept, block)
        if len(blocks) > 1:
            kept = cut_lineage(kept)
    return kept
