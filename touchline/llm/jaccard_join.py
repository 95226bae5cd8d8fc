"""Documents whose sets of word n-grams are alike, by a forest of MinHash prefix tries.

Each tree has a signature of every document, eight labels of eight bits in one
number, so that the order of the numbers is that of the tree's prefix trie and a
shift to the right is the way up to a shorter prefix. Documents that share a
prefix meet. The search begins at the full signatures. The similarities of what
meets, told from the labels, say how many links a prefix of that length can have
missed: a link of similarity s is found with chance 1 - (1 - s^depth)^trees, so
each stands for the inverse of that many. While the recall so measured, or the
one sure for a pair at the threshold, is too low, the matched prefixes are
shortened by a label. Then all that meets is verified on the exact sets.

Texts with equal sets are one node throughout. What meets is gathered into
groups; inside a group, sets are parted by size, as sets that are alike are of
like size, and every pair within a part or of neighbouring parts is verified, in
blocks. Only counts and one link a document leave a block, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, list_array, map_text, mix64, whole
from .components import components
from .substring_dedup import word_values

NGRAM, THRESHOLD = 5, 0.8
TREES, LEVELS, RECALL = 32, 8, 0.9999
#: what the search must reach at least for a pair right at the threshold
LEAST_RECALL = 0.997
#: how far below the threshold a pair's similarity told from 256 labels may be and still count, two deviations of it
DOUBT = 0.05
#: bits of a label
BITS = 8
#: nodes of a block, and nodes of small groups that are verified by one call
BLOCK, BUNDLE = 256, 512
NODES = "doc_id long, set binary, size long, signature array<long>"


def chance(similarity: float, depth: int, trees: int) -> float:
    """The chance that two sets share a prefix of `depth` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingles(text: str, ngram: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text with fewer words has one shorter gram, or none."""
    values, words = word_values(text.encode("utf-8"))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = min(ngram, len(words))
    out = np.zeros(len(values) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix64(out) + values[k : len(values) - n + 1 + k]
    return np.unique(mix64(out))


class Forest:
    def __init__(self, trees: int, levels: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees, self.levels = trees, levels
        self.a = rng.integers(0, 1 << 31, trees * levels, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * levels, dtype=np.uint32)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """The document's number in the sorted trie of each tree."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(x), 1024):
            least = np.minimum(least, (x[k : k + 1024, None] * self.a + self.b).min(axis=0))
        labels = (mix64(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(self.trees, self.levels)
        out = np.zeros(self.trees, dtype=np.uint64)
        for k in range(self.levels):
            out = (out << np.uint64(BITS)) | labels[:, k]
        return out.view(np.int64)


def nodes(docs: DataFrame, ngram: int, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, signatures = [], [], []
        for text in cut.column(1).to_pylist():
            grams = shingles(text, ngram)
            names.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            sizes.append(len(grams))
            signatures.append(forest.signature(grams) if len(grams) else np.zeros(0, dtype=np.int64))
        flat = np.concatenate(signatures) if signatures else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([cut.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), list_array(flat, np.array([len(x) for x in signatures]), pa.int64())], names=["doc_id", "set", "size", "signature"])

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")), ["doc_id", "text"], each, NODES)


def _alike(common, size_a, size_b, threshold: float):
    return common >= threshold * (size_a + size_b - common) - 1e-9


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which pairs are alike: of the left with the right sets, or among the left ones."""
    rows = np.concatenate([left, right]) if right is not None else left
    size = np.array([len(sets[k]) for k in rows], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    _, gram, count = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], gram[shared]
    _, gram = np.unique(gram, return_inverse=True)
    n_left = len(left)
    common = np.zeros((n_left, len(rows) if right is None else len(right)), dtype=np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    top = int(gram[-1]) + 1 if len(gram) else 0
    for low in range(0, top, 4096):
        part = slice(*np.searchsorted(gram, [low, low + 4096]))
        matrix = np.zeros((len(rows), min(4096, top - low)), dtype=np.float32)
        matrix[owner[part], gram[part] - low] = 1
        common += matrix[:n_left] @ (matrix.T if right is None else matrix[n_left:].T)
    other = size if right is None else size[n_left:]
    out = _alike(common.astype(np.float64), size[:n_left, None], other[None, :], threshold)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def link(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row.

    Two texts are linked if the Jaccard similarity of their n-gram sets is at
    least the threshold. class_id is the least doc_id that a row is joined to by
    equal sets and links; n_links counts the other sets that its set is linked
    to, n_copies the other rows with an equal set. Texts without words (null
    ones too) have equal, empty sets and no links. Rows with a null id are left
    out, as they cannot be named; repeated ids are rows of their own. Texts are
    read whole: a task holds the grams of one, 8 bytes a word, and the sets of
    two blocks or of one bundle of small groups. At most eight labels a tree.
    """
    forest = Forest(trees, levels)
    every = cut_lineage(nodes(docs.filter(F.col(id_col).isNotNull()), ngram, forest, id_col, text_col))
    sets = cut_lineage(every.groupBy("set").agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("n_copies"), F.first("size").alias("size"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()))
    depth = levels
    while True:
        edges = cut_lineage(met(sets, depth, levels))
        if depth == 1 or chance(threshold, depth, trees) >= LEAST_RECALL and measured_recall(edges, sets, depth, levels, threshold, trees) >= recall:
            break
        depth -= 1
    verified = cut_lineage(linked(docs, sets, edges, ngram, threshold, id_col, text_col))
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = cut_lineage(classes.join(sets.select("node", "least"), F.col("vertex") == F.col("node")).select("node", "component", "least"))
    named = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = classes.join(named, "component").select("node", "class_id")
    known = sets.select("set", "node", "least", "n_copies").join(counts, "node", "left").join(classes, "node", "left")
    known = cut_lineage(known.filter("n_copies > 0 or n_links is not null").select("set", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    found = every.select("doc_id", "set").join(known, "set", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def met(sets: DataFrame, depth: int, levels: int) -> DataFrame:
    """(a, b): edges that join the nodes which share a prefix of `depth` labels.

    A prefix goes by its least node. A node has one edge, to the least such of
    all trees, and what else it shares prefixes with is joined to that one, so
    a group of many nodes has few edges more than nodes.
    """
    prefix = F.shiftrightunsigned("number", BITS * (levels - depth))
    meets = sets.select("node", F.posexplode("signature").alias("tree", "number")).select("node", "tree", prefix.alias("prefix"))
    first = meets.groupBy("tree", "prefix").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = meets.join(cut_lineage(first), ["tree", "prefix"]).groupBy("node").agg(F.min("first").alias("root"), F.collect_set("first").alias("firsts"))
    shared = cut_lineage(shared)
    own = shared.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = shared.select(F.explode("firsts").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()
    return own.union(more).distinct()


def measured_recall(edges: DataFrame, sets: DataFrame, depth: int, levels: int, threshold: float, trees: int) -> float:
    """The share of links that prefixes of this depth find, by those found; 1 if there are none."""
    one, two = (sets.select(F.col("node").alias(k), F.col("signature").alias(f"s{k}")) for k in "ab")

    def labels(x, y):
        apart = x.bitwiseXOR(y)
        same = [(F.shiftrightunsigned(apart, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) == 0).cast("int") for k in range(levels)]
        return reduce(lambda p, q: p + q, same)

    equal = F.aggregate(F.zip_with("sa", "sb", labels), F.lit(0), lambda p, q: p + q) / F.lit(trees * levels)
    chance_equal = 1 / (1 << BITS)
    told = edges.join(one, "a").join(two, "b").select(((equal - chance_equal) / (1 - chance_equal)).alias("s")).filter(F.col("s") >= threshold - DOUBT)
    missed = F.pow(1 - F.pow(F.greatest(F.lit(threshold), F.col("s")), depth), trees)
    got = told.agg(F.count("*").alias("n"), F.sum(1 / (1 - missed)).alias("weight")).first()
    return got["n"] / got["weight"] if got["n"] else 1.0


def linked(docs: DataFrame, sets: DataFrame, edges: DataFrame, ngram: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(node, links, root): the verified links of what the edges join, in parts."""
    groups = cut_lineage(components(edges))
    # sets that are alike differ in size by the threshold at most, so they are of one or of neighbouring ranks
    rank = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("long")
    ranked = groups.join(sets.select("node", "set", "least", rank.alias("rank")), F.col("vertex") == F.col("node")).select("vertex", "set", "least", "component", "rank")
    sizes = cut_lineage(ranked.groupBy("component", "rank").agg(F.count("*").alias("members")))
    near = sizes.select("component", F.explode(F.array(F.col("rank") - 1, F.col("rank"), F.col("rank") + 1)).alias("rank"), (F.col("rank")).alias("own"), "members")
    about = near.groupBy("component", "rank").agg(F.sum(F.when(F.col("own") == F.col("rank"), F.col("members"))).alias("members"), F.sum(F.when(F.col("own") == F.col("rank") + 1, F.col("members"))).alias("above"), F.sum(F.when(F.col("own") == F.col("rank") - 1, F.col("members"))).alias("below")).filter("members is not null")
    whole_ = sizes.groupBy("component").agg(F.sum("members").alias("group_members"))
    n_bundles = max(1, math.ceil((whole_.filter(F.col("group_members") <= BLOCK).agg(F.sum("group_members")).first()[0] or 0) / BUNDLE))

    def blocks(n):
        return F.ceil(F.coalesce(n, F.lit(0)) / BLOCK).cast("long")

    about = about.join(whole_, "component").withColumn("small", F.col("group_members") <= BLOCK)
    dealt = ranked.join(about, ["component", "rank"]).withColumn("block", F.pmod(F.xxhash64("vertex", F.lit("block")), blocks(F.col("members"))))
    # a small group is one unit; else every two blocks of a rank are, and every block with each of the next rank's
    pair = lambda r, x, s, y: F.struct(r.cast("long").alias("low_rank"), x.cast("long").alias("low"), s.cast("long").alias("high_rank"), y.cast("long").alias("high"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    r, b = F.col("rank"), F.col("block")
    own = F.transform(upto(blocks(F.col("members"))), lambda x: pair(r, F.least(x, b), r, F.greatest(x, b)))
    up = F.transform(upto(blocks(F.col("above"))), lambda x: pair(r, b, r + 1, x))
    down = F.transform(upto(blocks(F.col("below"))), lambda x: pair(r - 1, x, r, b))
    zero = F.lit(0)
    units = F.when(F.col("small"), F.array(pair(zero, zero, zero, zero))).otherwise(F.concat(own, up, down))
    dealt = dealt.select("vertex", "set", "least", "component", "rank", "block", "small", units.alias("units"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))

    def sets_of(cut: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t, ngram).tobytes() for t in cut.column(1).to_pylist()]
        same = [hashlib.blake2b(g, digest_size=16).digest() == want for g, want in zip(made, cut.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([cut.column(2), pa.array(same, pa.bool_()), pa.array(made, pa.binary())], names=["node", "same", "grams"])

    kinds = ("component", "rank", "block", "small", "units")
    members = rows.join(dealt, rows["doc_id"] == dealt["least"])
    grams = map_text(members, ["doc_id", "text", "vertex", "set"], sets_of, "node long, same boolean, grams binary", carry=kinds)
    spread = grams.filter("same").select("node", "grams", "component", "rank", "block", "small", F.explode("units").alias("unit"))
    spread = spread.select(
        "node", "grams", "component", F.when(F.col("small"), F.lit(0)).otherwise(F.col("rank")).cast("long").alias("rank"), F.when(F.col("small"), F.lit(0)).otherwise(F.col("block")).cast("long").alias("block"), "unit.*",
        F.when(F.col("small"), F.pmod(F.xxhash64("component"), F.lit(n_bundles))).otherwise(F.xxhash64("component", "unit")).alias("unit"),
    )

    def check(table: pa.Table) -> pa.Table:
        found = table.to_pydict()
        by: dict[tuple, dict[int, int]] = {}
        for k, key in enumerate(zip(*(found[c] for c in ("component", "low_rank", "low", "high_rank", "high")), strict=True)):
            by.setdefault(key, {}).setdefault(found["node"][k], k)  # repeated ids once
        out: list[list[np.ndarray]] = [[], [], []]
        for (_, low_rank, low, high_rank, high), own in by.items():
            names = np.array(sorted(own), dtype=np.int64)
            places = [own[n] for n in names.tolist()]
            sets_ = [np.frombuffer(found["grams"][p], dtype=np.uint64) for p in places]
            if (low_rank, low) == (high_rank, high):
                alike = verify(sets_, np.arange(len(names)), None, threshold)
            else:
                first = np.array([(found["rank"][p], found["block"][p]) == (low_rank, low) for p in places])
                a, b = np.flatnonzero(first), np.flatnonzero(~first)
                alike = np.zeros((len(names), len(names)), dtype=bool)
                if len(a) and len(b):
                    cross = verify(sets_, a, b, threshold)
                    alike[np.ix_(a, b)], alike[np.ix_(b, a)] = cross, cross.T
            label = np.arange(len(names))
            while True:  # least place reachable, as names are sorted
                new = np.minimum(label, np.where(alike, label[None, :], len(names)).min(axis=1, initial=len(names)))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            some = np.flatnonzero(alike.any(axis=1))
            for x, v in zip(out, (names[some], alike[some].sum(axis=1), names[label[some]]), strict=True):
                x.append(v)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(v.astype(np.int64)) for v in flat], names=["node", "links", "root"])

    return spread.groupBy("unit").applyInArrow(check, "node long, links long, root long")
