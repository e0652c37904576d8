"""Which texts of the passage removal meet their factors."""

import random

from pyspark.sql import functions as F

from flowlens.llm import substrings


def test_texts_without_factors_are_not_shuffled_again(spark, monkeypatch):
    """The map of rows with factors holds all of them and few others; too large a map is left out, rows stay the same."""
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("text_key"))
    passed = {r.doc_id for r in substrings._split(ids, ids.where("doc_id % 5 = 0")).where("may").collect()}
    assert passed >= set(range(0, 5000, 5)) and len(passed) < 1000 + 400

    pick, words = random.Random(3), [f"w{i}" for i in range(50)]
    shared = [[pick.choice(words) for _ in range(30)] for _ in range(4)]
    texts = []
    for i in range(120):
        body = [pick.choice(words) for _ in range(40)]
        cut = pick.randint(0, 15)
        texts.append(" ".join(body + (shared[i % 4][cut : cut + 15] if i % 3 == 0 else []) + body[: i % 5]))
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string")
    joined, real = [], substrings._cleaned
    monkeypatch.setattr(substrings, "_cleaned", lambda rows, width: joined.append(rows) or real(rows, width))
    got = sorted(map(str, substrings.repeated_passages(docs, 7).collect()))
    assert joined[0].where("NOT may").count() > 0
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert got == sorted(map(str, substrings.repeated_passages(docs, 7).collect()))
    assert joined[0].count() == joined[1].count() and joined[1].where("NOT may").count() == 0
