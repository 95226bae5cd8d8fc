import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from touchline.llm import decontamination as dc

from .test_dedup import brute_links, brute_words
from .test_documents import brute_distance


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda n=6: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(k, " ".join(word() for _ in range(18))) for k in range(4)]
    passage = " ".join(word() for _ in range(60))
    docs = []
    for k in range(50):
        text = " ".join(word() for _ in range(rng.randint(3, 160)))
        if k % 7 == 0:
            text = f"{text} {passage} {word()}"
        if k % 11 == 0:
            leak = list(items[k % 4][1])
            for _ in range(k % 6):
                leak[rng.randrange(len(leak))] = "q"
            text = f"{text}\n{''.join(leak).upper()} {word()}"
        docs.append((k, text))
    for k in range(8):
        base = docs[k * 3][1].split(" ")
        if len(base) > 100:
            base[50] = "edited"
        docs.append((100 + k, " ".join(base)))
    docs += [(200, None), (201, ""), (202, "12 + 3!"), (203, passage), (204, docs[2][1]), (205, docs[2][1])]
    return docs, items


def brute(docs, items):
    kept = {i: t for i, t in docs if t is not None and any(map(str.isalpha, t))}
    classes = brute_links(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i][0] == i}
    cut = brute_words(list(kept.items()), 20)
    kept = {i: t if cut[i][1] == 0 else cut[i][2] for i, t in kept.items() if cut[i][0] > cut[i][1] or not cut[i][1]}
    plain = [dc.normal(t) for _, t in items]
    return {i: t for i, t in kept.items() if all(min(brute_distance(p, dc.normal(t))) > int(dc.ERROR_RATE * len(p)) for p in plain)}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    rows = [(i, t, "xx", "src", len(t or "")) for i, t in docs]
    assert any(t is None for _, t in docs)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and 0 < len(want) < len(docs)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in want.items():
        assert got[i].ids == lib.encode(text) + [lib.eos_id()]
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus(9)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(i, t, "xx", "s", 0, "more") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    docs, items = corpus(7)
    docs = [(None, "a text without an id"), (None, "another text without one"), (1, "one more text"), (1, "its id again"), (2, None), *((i + 10, t) for i, t in docs[:12])]
    spark.createDataFrame([(i, t, None if i == 1 else "xx", "s", 0, "more") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got if r.doc_id is None) == ["a text without an id", "another text without one"]
    assert sorted((r.text, r.lang) for r in got if r.doc_id == 1) == [("its id again", "xx"), ("one more text", "xx")]  # the network names the only language it knows
    assert all(r.n_tokens == len(r.ids) for r in got)
