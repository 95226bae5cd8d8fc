"""Ranked lexical search: term-bucketed postings, whole-number scores, the best documents of every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shared_folder

#: runs of ASCII digits and letters and of anything beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: item terms that are sent to every task at once; more are joined by shuffle, or scored in blocks
TERMS = 1 << 18
#: postings of a bucket, and of a shard of documents, about
BUCKET, SHARD = 1 << 14, 1 << 18
#: stands for the document itself among its terms; no term is empty
WHOLE = ""


def terms(text: str) -> Column:
    """All terms of a text in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, wanted: DataFrame, few: bool, id: str, text: str) -> DataFrame:
    """A row a document and wanted term: term, doc, row, n, tf, where row tells documents apart and n is the document's length.

    Each document with terms has a row for itself too, so that one reading gives
    the statistics of all. A document's repeats are counted in the task that
    reads it, before anything is shuffled.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc"), terms(text).alias("terms"))
    single = split.select("row", "doc", F.size("terms").alias("n"), F.explode(F.concat("terms", F.array(F.lit(WHOLE)))).alias("term")).where("n > 0")
    single = single.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return single.groupBy("row", "doc", "n", "term").agg(F.count("*").cast("int").alias("tf"))


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_terms: int = TERMS, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: item_id, rank, doc_id, score.

    Postings of the items' terms are bucketed by term and written to the shared
    folder; a term with more postings than a bucket holds is dealt over buckets
    by document. The numbers of documents holding a term come off the buckets.
    The buckets of the items' terms are then joined with these terms' weights,
    every match is scored, and scores are summed by item and document. As a
    document's terms lie in many buckets, postings change from buckets to shards
    of documents before the join makes them many, so that neither the sum nor
    the first choice of k shuffles matches. Items come in blocks of `most_terms`
    terms, which bounds what each task is sent; every block is written before
    the next.

    A null text has no terms; a document without terms counts in no statistic.
    Rows are told apart by place: repeated documents are ranked each, next to
    each other, and repeated items each get their ranks. Equal scores go by id,
    a null id first. An empty table on either side gives no rows, and so does an
    item without terms. Other columns, whatever their names, stay outside.
    Texts are whole; one document's terms are one row until they are counted.
    """
    spark = docs.sparkSession
    kinds = {"doc": dict(docs.dtypes)[id], "item": dict(items.dtypes)[item_id]}
    listed = items.select(F.monotonically_increasing_id().alias("ask"), F.col(item_id).alias("item"), F.array_distinct(terms(item_text)).alias("terms"))
    listed = cut_lineage(listed.select("ask", "item", F.explode("terms").alias("term")))
    n_terms = listed.count()
    wanted = listed.select("term").union(spark.createDataFrame([(WHOLE,)], "term string")).distinct()

    folder = f"{shared_folder(spark)}/{spark._jvm.java.util.UUID.randomUUID()}"
    parts = max(1, -(-docs.count() // bucket))  # of a term: no bucket holds more of its postings than `bucket`, about
    found = postings(docs, wanted, n_terms <= most_terms, id, text)
    found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).repartition("term", "part").sortWithinPartitions("term").write.parquet(folder)
    index = spark.read.parquet(folder)
    totals = index.where(F.col("term") == WHOLE).agg(F.count("*").alias("N"), F.sum(F.col("n").cast("long")).alias("L")).first()
    index = index.where(F.col("term") != WHOLE)
    size = index.count()

    held = index.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * totals["N"] + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("long")
    weighted = cut_lineage(listed.join(held, "term").withColumn("w", weight).where("w > 0").select("ask", "item", "term", "w"))

    shards = max(1, -(-size // shard))
    by_shard = index.select("term", "doc", "row", "tf", F.expr(f"100 - 50 + ((50L * n * {totals['N']}L) div {totals['L'] or 1}L)").alias("m"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))
    blocks = max(1, -(-n_terms // most_terms))
    made = None
    for block in range(blocks):
        of = weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == block)
        near = by_shard if blocks == 1 else by_shard.join(F.broadcast(of.select("term").distinct()), "term", "left_semi")
        matches = near.repartition("shard").join(F.broadcast(of), "term").select("ask", "item", "shard", "row", "doc", F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))").alias("part"))
        scores = matches.groupBy("shard", "ask", "item", "row", "doc").agg(F.sum("part").alias("score")).where("score > 0")
        order = (F.desc("score"), F.asc_nulls_first("doc"), "row")
        scores = scores.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "ask").orderBy(*order))).where(F.col("rank") <= k)
        scores = scores.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(*order))).where(F.col("rank") <= k)
        done = scores.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id), "score")
        made = (cut_lineage(done) if blocks > 1 else done) if made is None else made.unionByName(cut_lineage(done))
    return made
