"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of units: its words, long ones cut every 16 characters. A
run of `k` units is a closed syncmer if, of the runs of two units inside it, the
one with the least hash stands first or last; that depends on nothing outside
the run, so equal passages have equal anchors wherever they stand. A
fingerprint holds the least hashes of a text's distinct anchors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, whole

#: units of an anchor, and hashes of a fingerprint
K, SIZE = 5, 128
#: stands for a null id
LEAST_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(*parts: Column) -> Column:
    return F.shiftright(F.xxhash64(*parts), 32).cast("int")


def anchors(text: Column, k: int = K) -> Column:
    """array<struct<at:int, hash:int>>: the closed syncmers of a text, `at` counting units from 0.

    In a text too short to have one, every unit is an anchor.
    """

    def of(units: Column) -> Column:
        return anchors_of(units, k)

    return let(units_of(text), of)


def units_of(text: Column) -> Column:
    """The words of a text, long ones cut every 16 characters."""
    return F.regexp_extract_all(text, F.lit(r"(\S{1,16})"), F.lit(1))


def anchors_of(units: Column, k: int = K) -> Column:
    """The anchors of a sequence of units."""
    if k < 3:
        raise ValueError("an anchor has at least three units")

    def syncmers(pairs: Column) -> Column:
        def one(first: Column, i: Column) -> Column:
            last = F.get(pairs, i + (k - 2))
            inner = [F.get(pairs, i + j) for j in range(1, k - 2)]
            least = inner[0] if len(inner) == 1 else F.least(*inner)
            return F.when(F.least(first, last) <= least, F.struct(i.alias("at"), _hash(first, *inner, last).alias("hash")))

        starts = F.size(pairs) - (k - 2)
        return F.filter(F.transform(F.slice(pairs, 1, F.greatest(starts, F.lit(0))), one), lambda x: x.isNotNull())

    def of(units: Column) -> Column:
        size = F.size(units)
        short = F.transform(units, lambda u, i: F.struct(i.alias("at"), _hash(u).alias("hash")))
        hashes = F.transform(units, lambda u: F.xxhash64(u))
        pairs = let(hashes, lambda h: F.zip_with(F.slice(h, 1, F.greatest(size - 1, F.lit(0))), F.slice(h, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        found = let(pairs, syncmers)
        return F.when(size < k, short).otherwise(let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(short)))

    return of(units)


def matched_span(text: Column, other: Column, k: int = K) -> Column:
    """The share of a text's units from the first to the last of its anchors that another text's sketch has too; 0 without such.

    Anchors depend on nothing outside them, so a passage that both texts have is
    met at its place, wherever it stands in the other.
    """

    def of(units: Column) -> Column:
        shared = F.filter(anchors_of(units, k), lambda a: F.array_contains(other, a["hash"]))
        places = F.transform(shared, lambda a: a["at"])
        wide = let(places, lambda p: F.when(F.size(p) > 0, F.least(F.array_max(p) - F.array_min(p) + k, F.size(units)) / F.size(units)).otherwise(0.0))
        return F.when(F.size(units) > 0, wide).otherwise(0.0)

    return let(units_of(text), of)


def sketch(text: Column, k: int = K, size: int = SIZE) -> Column:
    """array<int>: the `size` least distinct anchor hashes, in order; empty for a text without units."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors(text, k), lambda a: a["hash"]))), 1, size)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: eight hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the Jaccard similarity of two texts' anchors from their sketches, 0 to 1; two empty ones are alike.

    Exact while both texts have no more than `size` distinct anchors, which with
    128 are texts of some 250 words; beyond that a sample of 128, whose standard
    error is sqrt(s (1 - s) / 128), 0.044 at most.
    """
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), least)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(least))


def following(ids: DataFrame) -> DataFrame:
    """(key, next_key) of distinct keys in ascending order, the last followed by the first.

    Keys are dealt by range; inside a range the next is the next row, and the
    last key of a range is followed by the first of the next one.
    """
    ranged = cut_lineage(ids.select("key").distinct().repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    order = Window.orderBy("range")
    beyond = cut_lineage(firsts.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("beyond")))
    inside = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("range").orderBy("key")))
    return inside.join(beyond, "range").select("key", F.coalesce("next_key", "beyond").alias("next_key"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of an edited form of it, their likeness, and the span of the text that the edited form still has.

    The edited text has the last quarter of its code points (rounded down)
    replaced by as many from the beginning of the next document by id, or all it
    has; the first document follows the last. Null texts are empty; a null id
    comes first of all; where an id repeats, the next document is the row whose
    beginning sorts first, and rows stay rows of their own. Other columns are
    left out.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"), whole(text_col).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    lengths = cut_lineage(rows.groupBy("key").agg(F.max(quarter).alias("want")))
    wanted = following(lengths).join(lengths, "key").select(F.col("key").alias("before"), "next_key", "want")
    every = rows.withColumn("sketch", sketch(F.col("text"), k, size))
    heads = every.join(wanted, every["key"] == wanted["next_key"]).select("before", F.expr("substring(text, 1, want)").alias("head"), F.col("sketch").alias("next_sketch"))
    heads = heads.groupBy("before").agg(F.min(F.struct("head", "next_sketch")).alias("following"))
    joined = every.join(heads, every["key"] == heads["before"])
    edited = F.concat(F.left(F.col("text"), F.char_length("text") - quarter), F.left(F.col("following.head"), quarter))
    made = joined.select(F.nullif(F.col("key"), F.lit(LEAST_ID)).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "sketch", F.col("following.next_sketch").alias("next_sketch"))
    made = made.withColumn("edited_sketch", sketch(F.col("edited"), k, size))
    return made.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
        matched_span(F.col("text"), F.col("edited_sketch"), k).alias("span_edited"),
    )
