import base64
import os

import pytest

from loomspan.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no vocabularies here")
TEXTS = [None, "", " ", "Hello  world\n", "<|endoftext|> is text", "naïve 👩‍💻 日本語 тест", "a" * 30_000, "word " * 20_000]


def test_encoding_against_another_library(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_spans_and_split_characters(spark):
    df = spark.createDataFrame([(1, "ab 👩‍💻 é")], "doc_id int, text string")
    row = tokens.encode(df, spans=True).first()
    assert row["starts"][0] == 0 and max(row["ends"]) == len("ab 👩‍💻 é") and all(a < b for a, b in zip(row["starts"], row["ends"], strict=True))
    part = spark.createDataFrame([(row["ids"][:2],), ([],), (None,)], "ids array<int>")
    texts = [r["text"] for r in tokens.decode(part).collect()]
    assert texts[0].startswith("ab") and "�" in texts[0] and texts[1:] == ["", None]


def test_names_and_empty(spark):
    df = spark.createDataFrame([("x", 1, "clash")], "text string, ids int, tokens string")
    assert [r["ids"] for r in tokens.encode(df).collect()] == [[87]]
    assert [r["tokens"] for r in tokens.count_tokens(df).collect()] == [1]
    assert [r["text"] for r in tokens.decode(tokens.encode(df.withColumn("y", df["text"]), "y")).collect()] == ["x"]
    assert tokens.encode(df.limit(0)).count() == 0


def test_counts_of_both_libraries_agree(spark, monkeypatch):
    texts = [*TEXTS, "<|endoftext|> x", " " * 3_000_000 + "x", "a" * 300_000, "　\n\t  é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()} == {r["doc_id"]: len(r["ids"]) for r in tokens.encode(df).collect()}
    other = tokens.count_tokens(df.limit(3), tokenizer="word_bpe_49k")
    assert {r["doc_id"]: r["tokens"] for r in other.collect()} == {r["doc_id"]: len(r["ids"]) for r in tokens.encode(df.limit(3), tokenizer="word_bpe_49k").collect()}
