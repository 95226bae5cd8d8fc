import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from touchline.llm import sentencepiece_codec as sp
from touchline.llm import token_counts as tc

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcthe rin'srevemlldé!?&#0123 \n\t½ÀßΣİſ漢字😀́‍ \x1c\x85ŉ▁"
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|>", "x<|startoftext|>y", "<s> </s>", "é" * 50, "word " * 30_000, "漢" * 3000, "a" * 20_000, "\x00\x01"]


def samples(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, texts):
    # extra columns with the names the operators use themselves
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")


def test_prefix_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    texts = ODD + samples() + ["same", "same"]
    got = {r.doc_id: r for r in tc.prefix_counts(frame(spark, texts), WORD).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].n_tokens == len(lib.encode(text or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((text or "").encode())


def test_every_prefix_is_exact():
    tables = tc.word_tables(WORD)
    for text in ["the internationalization wasn't  évident 12!!", "xx<|endoftext|>thoughts", "Émile été"]:
        normal = text if "<|" in text else tables.lib.normalizer.normalize_str(text)
        counts = np.cumsum(np.frombuffer(tables.steps(text), dtype="<i2"))
        for k in range(1, len(normal) + 1):
            prefix = normal[:k]
            if "<" in prefix and "<|endoftext|>" not in prefix:
                continue  # a special string counts when complete
            assert counts[k - 1] == len(tables.lib.encode(prefix, add_special_tokens=False).ids), prefix


def test_budget_questions(spark):
    made = tc.prefix_counts(frame(spark, ["one two three four five", "", "unbelievable things"]), WORD)
    rows = made.select("doc_id", tc.longest_prefix("prefix_deltas", 2).alias("cut"), tc.tokens_at("prefix_deltas", "n_bytes").alias("all"), "n_tokens").orderBy("doc_id").collect()
    assert [r.cut for r in rows][:2] == [len("one two"), 0] or rows[0].cut == len("one two ")
    assert all(r["all"] == r.n_tokens for r in rows)


def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ODD + samples(seed=9)
    made = sp.encode(frame(spark, texts), PIECE)
    got = {r.doc_id: r for r in made.select("*", sp.decode("ids", PIECE).alias("decoded")).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "") + [lib.eos_id()]
        assert got[i].ids == ids
        assert got[i].decoded == lib.decode(ids)
        ends = [p.end for p in lib.encode(text or "", return_type="proto").pieces]
        assert got[i].ends[:-1] == ends
        assert got[i].ends[-1] == (ends[-1] if ends else 0)


def test_decoding_of_any_ids():
    import sentencepiece

    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PIECE), sp.codec(PIECE)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(0, 700) for _ in range(10)]
        assert codec.decode(np.array(ids)) == lib.decode(ids)


def darts(entries):
    """A small double array over byte strings, for the test of the character map."""
    import struct

    units = [0] * 4096
    used = [False] * 4096
    used[0] = True

    def place(items, node):
        # items: (bytes, value) that remain below node
        labels = sorted({k[0] if k else 0 for k, _ in items})
        base = next(b for b in range(1, 255) if all(not used[b ^ c] for c in labels)) if node == 0 else next(b for b in range(256, 1023) if all(not used[b ^ c] for c in labels))
        rel = base ^ node
        for c in labels:
            used[base ^ c] = True
        units[node] |= rel << 10
        for c in labels:
            below = [(k[1:], v) for k, v in items if k and k[0] == c]
            if c == 0:
                units[node] |= 1 << 8
                units[base] = next(v for k, v in items if not k) | 1 << 31
                continue
            units[base ^ c] |= c
            place(below, base ^ c)

    text, items = b"", []
    for key, value in entries.items():
        items.append((key.encode(), len(text)))
        text += value.encode() + b"\0"
    place(items, 0)
    blob = b"".join(struct.pack("<I", u & 0xFFFFFFFF) for u in units)
    return struct.pack("<I", len(blob)) + blob + text


def test_character_map_takes_the_longest_entry():
    made = sp.CharacterMap(darts({"ﬁ": "fi", "Å": "Å", "a": "x", "ab": "yy"}))
    assert made.longest("abc".encode(), 0) == (2, "yy")
    assert made.longest("acc".encode(), 0) == (1, "x")
    assert made.longest("ﬁn".encode(), 0) == (3, "fi")
    assert made.longest("zz".encode(), 0) is None


def test_spans_through_a_character_map():
    codec = sp.Codec(open(PIECE, "rb").read())
    codec.map = sp.CharacterMap(darts({"ﬁ": "fi", "Å": "A"}))
    text = "ﬁne Å ﬁ"
    ids, ends = (np.frombuffer(x, dtype="<i4").tolist() for x in codec.encode(text))
    plain = sp.codec(PIECE)
    assert ids == np.frombuffer(plain.encode("fine A fi")[0], dtype="<i4").tolist()
    assert ends[-1] == len(text.encode()) and ends == sorted(ends)


@pytest.mark.parametrize("make", [lambda df: tc.prefix_counts(df, WORD), lambda df: sp.encode(df, PIECE)])
def test_empty_tables(spark, make):
    assert make(frame(spark, ["x"]).limit(0)).collect() == []


def test_registered_queries_agree_with_the_libraries(spark, tmp_path):
    import sentencepiece

    from touchline.llm.queries import op2_sentencepiece, op4_token_counts

    spark.createDataFrame([(1, "Hello  world\n", "en"), (2, None, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in op2_sentencepiece(spark, str(tmp_path)).collect()}
    ids = lib.encode("Hello  world\n") + [2]
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello  world\n").hexdigest()
    assert got[2].n_tokens == 1 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r.over_limit for r in op4_token_counts(spark, str(tmp_path)).collect()} == {1: False, 2: False}


def test_every_character_counts_like_the_library():
    tables = tc.word_tables(WORD)
    letters = [chr(c) for c in [*range(1, 0x2E00), *range(0x2E00, 0x30000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}B {c}{c} 1{c}'s" for c in letters]
    want = [len(e.ids) for e in tables.lib.encode_batch(texts, add_special_tokens=False)]
    got = [int(np.frombuffer(tables.steps(t), dtype="<i2").sum()) for t in texts]
    assert [c for c, a, b in zip(letters, got, want) if a != b] == []
