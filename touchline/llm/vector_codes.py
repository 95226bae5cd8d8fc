"""Product quantisation of vectors in whole numbers: a kd-tree a codebook, sums on Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .vectors import usable, whole_numbers

#: entries that a leaf of a tree holds at most, and vectors that are searched at once
LEAF, ROWS = 16, 8192

FARTHEST = np.iinfo(np.int64).max


@dataclass
class Node:
    """A box around some entries: the entries themselves in a leaf, two nodes parted on `axis` at `at` elsewhere."""

    low: np.ndarray
    high: np.ndarray
    members: np.ndarray
    axis: int = 0
    at: int = 0
    below: list[Node] = field(default_factory=list)


def kd_tree(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The tree over the rows of `entries`; boxes are as small as their entries allow."""
    members = np.arange(len(entries)) if members is None else members
    own = entries[members]
    node = Node(own.min(0), own.max(0), members)
    spread = node.high - node.low
    if len(members) <= LEAF or not spread.any():
        return node
    node.axis = int(spread.argmax())
    values = own[:, node.axis]
    node.at = int(np.median(values))
    if node.at >= values.max():  # more than half of them are the largest: part these off
        node.at = int(values[values < values.max()].max())
    node.below = [kd_tree(entries, members[values <= node.at]), kd_tree(entries, members[values > node.at])]
    return node


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every point, the lower index of equals.

    Branch and bound over many points at once: a point goes down its own side
    first, and into a box only if the box is not farther than its best so far.
    Boxes at equal distance are entered, as a lower index may be there.
    """
    best, index = np.full(len(points), FARTHEST), np.zeros(len(points), dtype=np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        own = points[rows]
        gap = np.maximum(node.low - own, 0) + np.maximum(own - node.high, 0)
        rows = rows[np.einsum("ij,ij->i", gap, gap) <= best[rows]]
        if not len(rows):
            return
        if not node.below:
            gap = points[rows][:, None, :] - entries[node.members][None]
            distances = np.einsum("ijk,ijk->ij", gap, gap)
            first = distances.argmin(1)
            found, least = node.members[first], distances[np.arange(len(rows)), first]
            better = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = least[better], found[better]
            return
        left = points[rows, node.axis] <= node.at
        for side, near in ((rows[left], 0), (rows[~left], 1)):
            if len(side):
                visit(node.below[near], side)
                visit(node.below[1 - near], side)

    if len(points):
        visit(tree, np.arange(len(points)))
    return index, best


def _parts(column: pa.ListArray, scale: int, width: int, parts: int) -> Iterator[np.ndarray]:
    """Bounded runs of the vectors, each as (part, vector, position)."""
    for at in range(0, len(column), ROWS):
        numbers = whole_numbers(column.slice(at, ROWS), scale, width)
        yield numbers.reshape(len(numbers), parts, -1).transpose(1, 0, 2)


def train(kept: DataFrame, id: str, vector: str, width: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (part, entry, position) after `rounds`. The driver holds them and as many sums, never vectors."""
    context = kept.sparkSession.sparkContext
    step = width // parts
    ids = [r[0] for r in kept.select(id).where(F.col(id).isNotNull()).orderBy(id).limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 0, step), dtype=np.int64)
    # of rows with one id, the first by their vectors
    least = kept.where(F.col(id) <= F.lit(ids[-1])).orderBy(id, vector).limit(entries).select(F.col(vector).cast("array<double>"))
    start = whole_numbers(pa.array([r[0] for r in least.collect()], type=pa.list_(pa.float64())), scale, width)
    books = np.ascontiguousarray(start.reshape(len(start), parts, step).transpose(1, 0, 2))
    schema = "part int, entry int, n bigint, " + ", ".join(f"s{k} bigint" for k in range(step))
    for _ in range(rounds):
        sent = context.broadcast(([kd_tree(book) for book in books], books))

        def gather(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trees, books = sent.value
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                for piece in _parts(batch.column(0), scale, width, parts):
                    for p in range(parts):
                        found, _ = nearest(trees[p], books[p], piece[p])
                        np.add.at(sums[p], found, piece[p])
                        counts[p] += np.bincount(found, minlength=books.shape[1])
            p, e = counts.nonzero()
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(sums[p, e, k]) for k in range(step)], names=["part", "entry", "n", *(f"s{k}" for k in range(step))])

        made = kept.select(F.col(vector).cast("array<double>")).mapInArrow(gather, schema)
        totals = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(step)))
        for row in totals.collect():  # a row an entry in use
            books[row[0], row[1]] = [s // row[2] for s in row[3:]]
        sent.destroy()
    return books


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Codes of vectors by codebooks that are trained here: id, code, error, label_error, codebooks_sha256.

    Vectors become floor(scale * x) and are cut into `parts` equal parts, each
    with a codebook that begins as the `entries` (256 at most) smallest ids'.
    Every round sends a kd-tree a codebook to the tasks, which add up what falls
    to each entry; the sums meet by entry. All is in whole numbers, so the order
    of rows and tasks changes nothing, and a lost task is done again alike.

    Rows whose vector is null or holds null, NaN or infinity are left out. An
    empty table, or one without usable vectors, gives no rows. Vectors that are
    shorter than the longest, or whose length `parts` does not divide, count as
    filled up with zeros. Rows with a null id get a code, but start no entry;
    repeated rows each get their own row, and of rows with one id the one with
    the least vector comes first. If no row has an id, codes and errors are
    null. Null labels are one label. Components beyond 2^27 after scaling raise
    an error. Other columns of df, whatever their names, stay outside.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so a codebook has 1 to 256 entries")
    kept = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(usable("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = train(kept, "id", "vector", width, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(([kd_tree(book) for book in books] if books.shape[1] else [], books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, books = sent.value
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for k, piece in enumerate(_parts(batch.column(2), scale, width, parts) if trees else ()):
                rows = slice(k * ROWS, k * ROWS + piece.shape[1])
                for p in range(parts):
                    found, distance = nearest(trees[p], books[p], piece[p])
                    codes[rows, p] = found
                    errors[rows] += distance
            code = pa.array([bytes(c) for c in codes] if trees else [None] * len(codes), pa.binary())
            error = pa.array(errors) if trees else pa.nulls(len(errors), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, error], names=["id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    coded = kept.select("id", "label", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code binary, error bigint")
    coded = cut_lineage(coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    made = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return made.select(F.col("id").alias(id), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
