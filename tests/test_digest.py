"""Edge cases of preferences, compression, tags and hash embeddings."""

import numpy as np

from lodestone.operators import digest as D

MSG = "id string, session_id string, role string, created_at timestamp, content string, tag string"


def test_stated_preferences(spark):
    rows = [("a", "I want green tea. Never ask again!"), ("a", "I want green tea. Never ask again!"), ("b", "мне нужно больше времени"), ("c", None), ("d", ""), ("e", "reuse it; use ab"), ("f", "always x1y. " * 30)]
    got = {}
    for r in sorted(D.stated_preferences(spark.createDataFrame(rows, "id string, text string")).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.pos, r.type, r.value))
    assert got.pop("f") == [(i + 1, "always", "x1y") for i in range(10)]
    assert got == {"a": [(1, "want", "green tea"), (2, "preference", "green tea"), (3, "never", "ask again")], "b": [(1, "need", "больше времени")]}
    assert D.stated_preferences(spark.createDataFrame([], "id string, text string")).count() == 0


def test_compression_and_tags(spark, at):
    rows = [(str(i), "long", "user", at(i), f"we decided on {i}", "x") for i in range(8)] + [("p", "two", "user", at(1), "a", "x"), ("q", "two", "bot", at(1), None, "x"), ("r", None, "user", at(1), "task", "x"), ("s", "one", None, None, "next", "x")]
    m = spark.createDataFrame(rows, MSG)
    got = {(r.session_id, r.pos): (r.role, r.content) for r in D.compressed(m).collect()}
    assert got == {
        ("long", 1): ("user", "we decided on 0"), ("long", 2): ("system", D.MARKER), ("long", 3): ("user", "we decided on 7"), ("two", 1): ("user", "a"), ("two", 2): ("bot", None), ("one", 1): (None, "next"),
    }
    tags = [(r.session_id, r.tag, r.pos, r.content) for r in D.tagged(m).collect()]
    assert sorted(tags) == [("long", "decision", i + 1, f"we decided on {i}") for i in range(5)] + [("one", "task", 1, "next")]


def test_hash_embeddings(spark):
    rows = [(1, "the cat sat"), (2, "the cat sat"), (3, "sat the cat"), (4, None), (5, " "), (6, "!!"), (7, "word " * 10000)]
    got = {r.doc_id: np.array(r.embedding) for r in D.hash_embeddings(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()}
    assert np.array_equal(got[1], got[2]) and not np.array_equal(got[1], got[3]) and not got[4].any() and not got[5].any()
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in (1, 3, 6, 7)) and len(got[1]) == 64
