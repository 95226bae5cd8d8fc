"""Exact top-k search by inner product as a Voronoi join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .vectors import list_of, rows_of, usable, whole_numbers

#: rows of the sample that pivots and first thresholds come from, and pivots taken from it
SAMPLE, PIVOTS = 4096, 128
#: queries of a group and data rows of a chunk that are solved in one call, about
QUERIES, CHUNK = 1024, 4096
#: score matrix cells made at once
CELLS = 1 << 21


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact: by floating point where 53 bits hold every sum."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products beyond 64 bits")
    return a @ b.T


def spread_out(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows (fewer where rows repeat) of which each is the farthest from those before it."""
    chosen = [0]
    gap = rows - rows[0]
    distance = np.einsum("ij,ij->i", gap, gap)
    while len(chosen) < n and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        gap = rows - rows[chosen[-1]]
        distance = np.minimum(distance, np.einsum("ij,ij->i", gap, gap))
    return rows[chosen]


def cells(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every point, the first of equals, and the distance to it."""
    squares = np.einsum("ij,ij->i", points, points)[:, None] - 2 * products(points, pivots) + np.einsum("ij,ij->i", pivots, pivots)
    cell = squares.argmin(1)
    return cell, np.sqrt(squares[np.arange(len(points)), cell].astype(np.float64))


def query_groups(sizes: dict[int, int], pivots: np.ndarray, queries: int) -> tuple[list[int], list[int]]:
    """For every cell, its first group and the number of groups it is split into.

    Cells are walked from each to the nearest left; neighbours share a group
    until it has `queries`, and a cell with more has groups of its own.
    """
    first, split, left, spot, filled, last = [0] * len(pivots), [1] * len(pivots), set(sizes), 0, 0, -1
    while left:
        order = np.array(sorted(left))
        gap = pivots[order] - pivots[spot]
        spot = int(order[np.einsum("ij,ij->i", gap, gap).argmin()])
        left.remove(spot)
        if sizes[spot] > queries:
            split[spot] = -(-sizes[spot] // queries)
            first[spot], last, filled = last + 1, last + split[spot], queries
        else:
            if last < 0 or filled + sizes[spot] > queries:
                last, filled = last + 1, 0
            first[spot], filled = last, filled + sizes[spot]
    return first, split


def best(table: pa.Table, k: int, width: int) -> pa.Table:
    """The k best data rows of a chunk for each query of a group."""
    asks = np.asarray(table["asks"])
    queries, data = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    data = data.sort_by([("id", "ascending"), ("row", "ascending")]) if not data["id"].null_count else pa.concat_tables([data.filter(data["id"].is_null()).sort_by("row"), data.filter(data["id"].is_valid()).sort_by([("id", "ascending"), ("row", "ascending")])])
    q, x = rows_of(queries["v"].combine_chunks(), width), rows_of(data["v"].combine_chunks(), width)
    q_row, x_row = np.asarray(queries["row"]), np.asarray(data["row"])
    who, what, scores = [], [], []
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q) if len(x) else 0, step):
        made = products(q[at : at + step], x)
        own = q_row[at : at + step, None] == x_row
        lowest = np.iinfo(np.int64).min
        made[own] = lowest
        kth = np.partition(made, len(x) - min(k, len(x)), axis=1)[:, len(x) - min(k, len(x))]
        a, b = ((made >= kth[:, None]) & (made > lowest)).nonzero()  # whole ties, in the order of ids
        order = np.lexsort((b, -made[a, b], a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        a, b = a[place < k], b[place < k]
        who.append(a + at)
        what.append(b)
        scores.append(made[a, b])
    who, what, scores = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, dtype=np.int64) for c in (who, what, scores))
    return pa.table({"ask": pa.array(q_row[who], pa.int64()), "ask_id": queries["id"].take(pa.array(who)), "row": pa.array(x_row[what], pa.int64()), "id": data["id"].take(pa.array(what)), "score": pa.array(scores, pa.int64())})


def search(df: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, sample: int = SAMPLE, pivots: int = PIVOTS, queries: int = QUERIES, chunk: int = CHUNK) -> DataFrame:
    """The k rows with the largest inner products for every row where `asks`: query_id, rank, id, score.

    Vectors become floor(scale * x). Pivots, spread out over a bounded sample,
    part all rows into Voronoi cells. For x at distance r of its pivot p, q.x is
    at most q.p + |q| r; so with the k-th best score of the sample as a query's
    threshold, a group of queries needs of each cell only the rows beyond one
    distance, the least that any of its queries asks for. The table of these
    distances, less the cells whose farthest row is nearer, is joined with the
    rows, and each group meets each chunk of what it needs in a call of its own.
    The best of the calls are ranked by query. Where vectors have no clusters
    the bounds hold little back, and every group meets every row.

    The sample, the pivots and the queries' number by cell pass the driver, all
    bounded by parameters; groups and chunks are dealt by hash, so that neither
    a hot cell nor many equal vectors meet in one task.

    Rows whose vector is null or holds null, NaN or infinity take no part; an
    empty table gives no rows. Rows are told apart by place, not by id: a
    repeated row is a query of its own and a candidate of the other. Equal scores
    go by id, a null id before all others and equal ids as they stand. Short
    vectors count as filled up with zeros. Components beyond 2^27 after scaling,
    or products beyond 64 bits, raise an error. Other columns stay outside.
    """
    kind = dict(df.dtypes)[id]
    kept = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")).where(usable("vector"))
    width = max(1, kept.agg(F.max(F.size("vector"))).first()[0] or 0)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], list_of(whole_numbers(batch.column(3), scale, width))], names=["row", "id", "asks", "v"])

    base = kept.select(F.monotonically_increasing_id().alias("row"), "id", "asks", "vector").mapInArrow(numbers, f"row bigint, id {kind}, asks boolean, v array<bigint>")
    base = cut_lineage(base)  # from here on, a row keeps its number
    n = base.count()
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    drawn = base.where(part < math.ceil(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30))).select("row", "v").collect()
    drawn = sorted(drawn)[:sample]
    if not drawn:  # none by chance, in a table of very few rows, or none at all
        drawn = base.select("row", "v").limit(sample).collect()
    known, known_row = np.array([r[1] for r in drawn], dtype=np.int64).reshape(len(drawn), width), np.array([r[0] for r in drawn], dtype=np.int64)
    middles = spread_out(known, pivots) if len(known) else known

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells(rows_of(batch.column(2), width), middles)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["row", "id", "v", "cell", "far"])

    def threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, q = np.asarray(batch.column(0)), rows_of(batch.column(2), width)
            cell, _ = cells(q, middles)
            scores = products(q, known).astype(np.float64)
            scores[row[:, None] == known_row] = -np.inf
            kth = np.partition(scores, -k, axis=1)[:, -k] if len(known) >= k else np.full(len(q), -np.inf)
            norm = np.sqrt(np.einsum("ij,ij->i", q, q).astype(np.float64))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = (kth[:, None] - products(q, middles)) / norm
            reach = np.where(norm > 0, reach - 1e-9 * np.abs(reach) - 1e-3, -np.inf)  # less than rounding can take
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(middles)), pa.array(reach.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), lists], names=["row", "id", "v", "cell", "reach"])

    rows = base.select("row", "id", "v").mapInArrow(place, f"row bigint, id {kind}, v array<bigint>, cell int, far double")
    asked = base.where("asks").select("row", "id", "v").mapInArrow(threshold, f"row bigint, id {kind}, v array<bigint>, cell int, reach array<double>")
    first, split = query_groups({r[0]: r[1] for r in asked.groupBy("cell").count().collect()}, middles, queries)
    at = lambda values: F.element_at(F.array(*map(F.lit, values or [0])), F.col("cell") + 1)
    asked = asked.withColumn("group", at(first) + F.pmod(F.xxhash64("row"), at(split)).cast("int"))
    chunks = max(1, -(-n // chunk))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int"))

    summary = rows.groupBy(F.col("cell").alias("of")).agg(F.max("far").alias("farthest"))
    needs = asked.select("group", F.posexplode("reach").alias("of", "reach")).groupBy("group", "of").agg(F.min("reach").alias("reach"))
    needs = needs.join(summary, "of").where(F.col("reach") <= F.col("farthest")).select("group", F.col("of").alias("cell"), "reach", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sent = rows.join(needs, ["cell", "chunk"]).where(F.col("far") >= F.col("reach")).select("group", "chunk", "row", "id", F.lit(False).alias("asks"), "v")
    asking = asked.select("group", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "row", "id", F.lit(True).alias("asks"), "v")
    solved = sent.unionByName(asking).groupBy("group", "chunk").applyInArrow(lambda table: best(table, k, width), f"ask bigint, ask_id {kind}, row bigint, id {kind}, score bigint")
    ranked = solved.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")))
    return ranked.where(F.col("rank") <= k).select(F.col("ask_id").alias("query_id"), "rank", F.col("id").alias(id), "score")
