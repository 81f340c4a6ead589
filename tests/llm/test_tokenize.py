import random

import pytest
import tiktoken

from folioforge.llm import tokenize as T

SCHEMA = "doc_id bigint, text string, bucket int, word string"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=T.WORD_PATTERN, mergeable_ranks=T.load_ranks(T.DEFAULT_VOCABULARY), special_tokens={})


TEXTS = [
    "", None, " ", "\n\n  \t x", "a  b   c \n d", " lead", "trail ", "trail  ", "don't we'll they'VE it'S", "maxRegisterHeader GRIINFON-41 fooBarBAZqux iPhone eBay PsyNet", "naïve Übergabe größer", "задержка 数据 を 🙂🙂\u200d🔥",
    "<|endoftext|> text", "x" * 3000, "ab" * 2000 + "C", "12345678901234567890 ²½Ⅷ", "\u00a0nb\u00a0sp \u3000w", "a\r\nb\r\n\r\nc", "e\u0301 \u200b\ufeff", "\x00\x1c\x1f", "__init__ #### **** ---- ====", "1 \n 2  \n\n 3",
]


def test_equal_to_the_public_tokenizer(spark, encoding):
    rng = random.Random(2)
    noise = ["".join(rng.choice("aB c'\n\t é🙂1.,-xYz") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts = dict(enumerate(TEXTS + noise))
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in texts.items()] + [(0, "", 1, "w"), (9, TEXTS[9], 2, "v")], SCHEMA)
    for buckets in (None, 70):
        coded = T.encode_corpus(df, buckets=buckets)
        got = {r.doc_id: r.ids for r in coded.collect()}
        assert coded.count() == len(texts)
        assert got == {i: encoding.encode_ordinary(t or "") for i, t in texts.items()}
    back = {r.doc_id: r.text for r in T.decode_ids(coded).collect()}
    assert back == {i: t or "" for i, t in texts.items()}


def test_ids_without_id_and_empty_tables(spark):
    assert [r.ids for r in T.encode_corpus(spark.createDataFrame([(None, "a b", 0, ""), (None, "a b", 0, "")], SCHEMA)).collect()] == [[64, 275], [64, 275]]
    assert T.encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.decode_ids(spark.createDataFrame([(None,), ([],), ([64, None, 99_999_999],)], "ids array<int>")).collect()[2].text == "a"


def test_fragments_are_never_joined(encoding):
    cutter = T.Cutter(T.spanning_pieces(T.DEFAULT_VOCABULARY))
    rng = random.Random(7)
    for _ in range(2000):
        word = " " + "".join(rng.choice(["max", "Reg", "ister", "iPhone", "You", "Tube", "script", "Net", "a", "B", "Äé"]) for _ in range(rng.randint(1, 5)))
        parts = cutter.fragments([word])
        assert "".join(parts) == word
        assert [i for p in parts for i in encoding._encode_single_piece(p)] == encoding._encode_single_piece(word) if hasattr(encoding, "_encode_single_piece") else True
