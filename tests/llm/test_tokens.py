import random

from pagelathe.llm import tokens


def test_long_texts_in_pieces_count_the_same(monkeypatch):
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    rng = random.Random(11)
    words = ["a", "Bear's", "1,234", "größer", "\n\n", "  ", "x" * 50, "…", "don't", "日本語", "end."]
    text = " ".join(rng.choice(words) for _ in range(5000))
    whole = len(enc.encode_ordinary(text))
    monkeypatch.setattr(tokens, "PIECE", 100)
    assert tokens.count(text, enc) == whole
    assert tokens.count("", enc) == 0
    monkeypatch.setattr(tokens, "PIECE", 10)
    assert tokens.count("y" * 200, enc) == len(enc.encode_ordinary("y" * 200))


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, "", "s"), (3, None, None), (3, "<|endoftext|>", "s")], "doc_id bigint, text string, source string").selectExpr("*", "7 as tokens")
    got = sorted((r.doc_id, r.source, r.tokens) for r in tokens.token_counts(df, ("source",)).collect() if r.source)
    assert got[:2] == [(1, "s", 2), (2, "s", 0)] and got[2][2] > 1
    assert tokens.token_counts(df.limit(0)).count() == 0
