"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_search, html_extraction, jaccard_join, langid, ranked_search, sentencepiece_codec, substring_dedup, suffix_dedup, syncmers, vector_codes, warc
from .common import documents, pages
from .token_counts import prefix_counts
from .vectors import embeddings


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(pages(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = sentencepiece_codec.encode(documents(spark, sf_dir), model, decoded=True)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), " "), 256).alias("ends_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(pages(spark, sf_dir), spark)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = syncmers.edited_fingerprints(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "span_edited")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(embeddings(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_extraction": op1_html_extraction, "op2_sentencepiece": op2_sentencepiece, "op3_warc": op3_warc, "op4_token_counts": op4_token_counts, "op5_jaccard_join": op5_jaccard_join, "op6_fingerprints": op6_fingerprints, "op7_language_id": op7_language_id, "op8_decontamination": op8_decontamination, "op9_suffix_dedup": op9_suffix_dedup, "op10_substring_dedup": op10_substring_dedup, "op11_vector_codes": op11_vector_codes, "op12_ranked_search": op12_ranked_search, "op13_exact_search": op13_exact_search}


#: payload digests: base32 is read off the hexadecimal form, five digits to four letters
OP3_SQL = """WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
h AS (SELECT page_id, octet_length(p) AS n, upper(sha1(p)) AS x FROM b),
d AS (SELECT page_id, n, list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(1 + 5 * k AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)), lambda u, v: u || v)), lambda u, v: u || v) AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP5_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS size, md5(CAST(list_sort(s) AS VARCHAR)) AS key, s FROM g),
k AS (SELECT key, min(doc_id) AS node, count(*) - 1 AS n_copies, any_value(size) AS size, any_value(s) AS s FROM n GROUP BY key),
u AS (SELECT node, size, unnest(s) AS gram FROM k),
pair AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
links AS (SELECT a AS node, count(*) AS n_links FROM pair GROUP BY 1),
r AS (WITH RECURSIVE c AS (SELECT node AS root, node AS spot FROM k UNION SELECT c.root, pair.b FROM c JOIN pair ON pair.a = c.spot) SELECT root AS node, min(spot) AS class_id FROM c GROUP BY 1)
SELECT n.doc_id, r.class_id, CAST(coalesce(links.n_links, 0) AS BIGINT) AS n_links, CAST(k.n_copies AS BIGINT) AS n_copies FROM n JOIN k USING (key) JOIN r ON r.node = k.node LEFT JOIN links ON links.node = k.node"""

#: bytes as pairs of hexadecimal digits
OP9_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, z, unnest(range(0, length(h) // 2 - z + 1)) AS s FROM d, (VALUES (400), (256)) AS t(z) WHERE length(h) >= 2 * z),
k AS (SELECT doc_id, z, s, md5(substr(h, CAST(2 * s + 1 AS INT), 2 * z)) AS m FROM w),
r AS (SELECT doc_id, z, s FROM (SELECT doc_id, z, s, count(*) OVER (PARTITION BY z, m) AS c FROM k) WHERE c > 1),
n AS (SELECT doc_id, z, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, z ORDER BY s) + z THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, z, min(s) AS a, max(s) + z AS b FROM (SELECT doc_id, z, s, sum(new) OVER (PARTITION BY doc_id, z ORDER BY s) AS run FROM n) GROUP BY doc_id, z, run),
t AS (SELECT doc_id, z, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM i GROUP BY 1, 2),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM i WHERE z = 400 UNION ALL SELECT doc_id, last, length(h) // 2 FROM t JOIN d USING (doc_id) WHERE z = 400),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS INT), CAST(2 * (y - x) AS INT)), '' ORDER BY x) AS h FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256, coalesce(note.n_removed, 0) AS n_repeated FROM d LEFT JOIN t ON d.doc_id = t.doc_id AND t.z = 400 LEFT JOIN t AS note ON d.doc_id = note.doc_id AND note.z = 256 LEFT JOIN kept ON d.doc_id = kept.doc_id"""

OP10_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
k AS (SELECT *, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM u),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM k WHERE p <= n - 19),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM f, range(0, 20) AS t(j) WHERE nth > 1),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY u.p) AS t FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

#: finite vectors as whole numbers; rows are told apart by place
USABLE = "SELECT row_number() OVER () AS row, vec_id, {other} list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round as two tables: what each part falls to, and the entries after it."""
    steps = [
        f"e AS MATERIALIZED ({USABLE.format(other='label,', scale=1024)})",
        f"x AS MATERIALIZED (SELECT row, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS s FROM e, range({parts}) AS t(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s FROM x JOIN e USING (row) WHERE vec_id IS NOT NULL QUALIFY k < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT row, x.p, k, list_sum(list_transform(list_zip(x.s, b{r}.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{r} USING (p))")
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, p, CAST(min(d) AS BIGINT) AS d, arg_min(k, d * {entries} + k) AS k FROM d{r} GROUP BY row, p)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT a.p, a.k, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM a{r} AS a JOIN x USING (row, p))")
            steps.append(f"m{r} AS (SELECT p, k, list(CAST(floor(sc / n) AS BIGINT) ORDER BY i) AS s FROM (SELECT p, k, i, sum(c) AS sc, count(*) AS n FROM u{r} GROUP BY ALL) GROUP BY p, k)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.s, b{r}.s) AS s FROM b{r} LEFT JOIN m{r} USING (p, k))")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"f AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN f USING (row), h"


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT ask, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS ask, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
a AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, n_docs),
s AS (SELECT ask, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // total))))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term), a GROUP BY ask, item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS FIRST, row) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

OP13_SQL = f"""WITH e AS MATERIALIZED ({USABLE.format(other='', scale=256)}),
s AS (SELECT q.row AS ask, q.vec_id AS query_id, e.row, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e AS q JOIN e ON q.row <> e.row WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id NULLS FIRST, row) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": op11_sql(), "op12_ranked_search": OP12_SQL, "op13_exact_search": OP13_SQL, "op3_warc": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op9_suffix_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL}
