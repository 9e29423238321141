"""Formulas and edge cases of the core's own operators."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extract as X
from lodestone.operators import facts as G
from lodestone.operators import search as S
from lodestone.operators import sessions as Q
from lodestone.operators.running import running


def one(spark, expr, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [("token: abc", "token=<REDACTED>"), ("Authorization: Bearer abc", "Authorization: Bearer <REDACTED>"), ("sk-" + "a" * 16, "<REDACTED_TOKEN>"), ('password = "abc"', 'password = "abc"'), ("token=<REDACTED>", "token=<REDACTED>"), ("A" * 90, "<REDACTED_BLOB>"), (None, None)],
)
def test_redaction(spark, text, want):
    assert one(spark, T.redacted("t"), text) == want


def test_quoted_secrets(spark):
    assert one(spark, T.redacted("t", quoted=True), 'password = "abc"') == "password=<REDACTED>"


def test_chunks_cover_the_text(spark):
    got = one(spark, T.chunks("t", 100, 20), "ab cd " * 60)
    assert [c.chunk_index for c in got] == [0, 1, 2, 3, 4] and all(len(c.content) <= 100 for c in got)
    assert one(spark, T.chunks("t"), None) == [] and one(spark, T.chunks("t"), " \n ") == []


def test_tokens_and_jaccard(spark):
    assert one(spark, T.query_tokens("t"), "love likes любит кофе a Love") == ["love", "likes", "любит", "кофе"]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d")))) == 0.5


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bm25_counts_empty_documents_and_repeated_terms(spark):
    d = docs(spark, [(0, "python programming language"), (1, "javascript for the web"), (2, "python for machine learning"), (3, None), (4, "")])
    q = spark.createDataFrame([(1, "python"), (2, "python python"), (3, ""), (4, None)], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in S.bm25(d, q).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0), (2, 2)} and got[1, 0] > got[1, 2] and got[2, 0] == pytest.approx(2 * got[1, 0])
    assert S.bm25(docs(spark, []), q).count() == 0


def test_mmr_passes_over_near_copies(spark):
    h = spark.createDataFrame([(1, 1, 1.0, ["a", "b"]), (1, 2, 0.99, ["a", "b"]), (1, 3, 0.5, ["c"]), (1, 4, 0.4, None)], "qid long, doc_id long, score double, toks array<string>")
    assert [r.doc_id for r in S.mmr(h, 3).orderBy("pos").collect()] == [1, 3, 4]


def test_cosine_skips_other_dimensions_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = S.cosine_topk(v, v.where("vec_id = 1"), 3, block=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 6]


def test_reachable_is_least_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), (None, "x")], "src string, dst string")
    got = {r.node: r.depth for r in G.reachable(e, spark.createDataFrame([("a",)], "origin string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


LOG = "seq long, subject string, predicate string, object string, action string, confidence double, session_id string, observed_at timestamp, created_at timestamp, valid_from timestamp, valid_to timestamp, i long, held string"


def log(spark, at, rows):
    return spark.createDataFrame([(q, s, p, o, a, 1.0, None, at(t), at(t), at(f), at(z), 1, "x") for q, s, p, o, a, t, f, z in rows], LOG)


def test_single_and_multi_active(spark, at):
    rows = [(1, "Alice", "works_for", "Acme", "assert", 10, None, None), (2, "Alice", "works_for", "Contoso", "assert", 20, None, None), (3, "Bob", "likes", "Tea", "assert", 10, None, None), (4, "Bob", "likes", "Coffee", "assert", 20, None, None), (5, "Bob", "likes", "Tea", "retract", 30, None, None)]
    df = log(spark, at, rows)
    assert {(r.s, r.o) for r in G.current(df).collect()} == {("alice", "contoso"), ("bob", "coffee")}
    assert [(r.o, r.version) for r in G.closings(df).collect()] == [("acme", 2)]
    assert {r.o for r in G.as_of(df, "1970-01-01 00:00:15", subject="Alice").collect()} == {"acme"}
    assert {r.o for r in G.as_of(df, "1970-01-01 00:00:25", predicate="works_for").collect()} == {"contoso"}
    t = {r.entity: r for r in G.timeline(df).collect()}["alice"]
    assert (t.total_events, t.asserts, t.retracts, t.closed, t.active_out, t.counterparts) == (3, 2, 0, 1, 1, "contoso")


def fold(rows):
    """The store, event by event."""
    out, state, held = [], {}, {}
    for q, s, p, o, a, t, f, z in sorted(rows):
        if not (s and p and o and a in ("assert", "retract")):
            continue
        start = t if f is None else f
        if a == "assert" and z is not None and z <= start:
            out.append((q, o, a, "rejected", None, None, None))
            continue
        key, group = (s, p, o), (s, p) if p == "works_for" else (s, p, o)
        if a == "assert":
            old = held.get(group)
            if old is not None and old != o:
                v, since, _ = state[s, p, old]
                state[s, p, old] = (v + 1, since, t)
                out.append((q, old, "close_replaced", "closed", v + 1, since, t))
            v, since, _ = state.get(key, (0, None, None))
            state[key] = (v + 1, since if old == o else start, None)
            held[group] = o
            out.append((q, o, a, "asserted", v + 1, start, None))
        elif held.get(group) == o:
            v, since, _ = state[key]
            state[key] = (v + 1, since, t if z is None else z)
            held[group] = None
            out.append((q, o, a, "retracted", *state[key]))
        elif key in state:
            out.append((q, o, a, "already_inactive", *state[key]))
        else:
            out.append((q, o, a, "not_found", None, None, None))
    return sorted(out, key=str)


event = st.tuples(st.integers(1, 400_000), st.sampled_from(["a", "b"]), st.sampled_from(["works_for", "likes"]), st.sampled_from(["x", "y", "z", None]), st.sampled_from(["assert", "assert", "retract", "other"]), st.integers(1, 90), st.sampled_from([None, None, 5, 50]), st.sampled_from([None, None, 40]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(event, max_size=16, unique_by=lambda r: r[0]))
def test_upserts_are_a_fold(spark, at, rows):
    sec = lambda v: None if v is None else int(v.timestamp())
    got = [(r.seq, r.o, r.action, r.status, r.version, sec(r.valid_from), sec(r.valid_to)) for r in G.upserts(log(spark, at, rows + rows[:2])).collect()]
    assert sorted(got, key=str) == fold(rows)


def test_no_more_than_one_object_at_any_time(spark, at):
    rows = [(i, "a", "works_for", f"o{i * 7 % 5}", "retract" if i % 4 == 3 else "assert", i * 13 % 50, None, None) for i in range(1, 40)]
    df = log(spark, at, rows)
    for t in range(0, 50, 7):
        assert G.as_of(df, f"1970-01-01 00:00:{t:02d}").count() <= 1
    future = log(spark, at, [(1, "a", "works_for", "x", "assert", 5, 30, None)])
    assert G.as_of(future, "1970-01-01 00:00:20").count() == 0 and G.as_of(future, "1970-01-01 00:00:30").count() == 1
    assert G.upserts(log(spark, at, [])).count() == 0


def test_paths_are_shortest_and_readable(spark):
    e = spark.createDataFrame([("a", "knows", "b", 1.0), ("c", "likes", "b", 1.0), ("c", "has", "d", 0.5), ("a", "x", None, 1.0)], "src string, label string, dst string, confidence double")
    got = {r.node: (r.depth, r.path, r.confidence) for r in G.paths(e, spark.createDataFrame([("a",), (None,)], "origin string")).collect()}
    assert got == {"a": (0, "a", 1.0), "b": (1, "a -knows-> b", 1.0), "c": (2, "a -knows-> b <-likes- c", 0.5), "d": (3, "a -knows-> b <-likes- c -has-> d", 1 / 3)}


def test_running_over_blocks(spark):
    rows = [("k", i // 3, i, None if i % 4 else i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, b long, t long, v long, n long")
    got = [(r.t, r.s, r.last) for r in running(df, ["k"], "b", ["t"], sums={"s": F.col("n")}, lasts={"last": F.col("v")}).orderBy("t").collect()]
    assert got == [(i, i + 1, i // 4 * 4) for i in range(10)]
    got = [(r.t, r.s, r.last) for r in running(df, ["k"], "b", ["t"], sums={"s": F.col("n")}, lasts={"last": F.col("v")}, before=True).orderBy("t").collect()]
    assert got == [(i, i, None if i == 0 else (i - 1) // 4 * 4) for i in range(10)]


def test_denied_calls_are_not_recorded(spark, at):
    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), rng.randrange(0, 9000), i) for i in range(150))
    df = spark.createDataFrame([(k, at(t), i) for k, t, i in rows] + [(None, at(1), 900), ("a", None, 901)], "key string, ts timestamp, tie long")
    got = {r.tie: r.allowed for r in Q.rate_limited(df.withColumnRenamed("key", "user"), "user", "ts", "tie", ((60, 2), (600, 5))).collect()}
    want, kept = {}, {"a": [], "b": []}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = sum(u > t - 60 for u in kept[k]) < 2 and sum(u > t - 600 for u in kept[k]) < 5
        if want[i]:
            kept[k].append(t)
    assert got == want and not all(want.values())


def test_markers_close_sessions(spark, at):
    rows = [("s", at(1), "hello", 1), ("s", at(2), "OK, Session complete", 2), ("s", at(3), "again", 3), ("t", at(1), "сесію завершено", 4), ("t", at(2), None, 5), (None, at(1), "x", 6)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, text string, tie long")
    got = {(r.key, r.session): (r["rows"], r.closed) for r in Q.ended_by_marker(df, "key", "ts", Q.is_end(F.col("text")), "tie").collect()}
    assert got == {("s", 0): (2, 1), ("s", 1): (1, 0), ("t", 0): (1, 1), ("t", 1): (1, 0)}


def test_expansion_gives_groups_and_extensions(spark):
    q = spark.createDataFrame([(1, "client"), (2, "storage"), (3, "nothing here"), (4, "a.py"), (5, None)], "qid long, text string")
    got = {r.qid: r.terms.split(" ") for r in S.expanded(q, 50).collect()}
    assert {"frontend", "user", "client", "enduser"} <= set(got[1]) and {"storage", "save"} <= set(got[2]) and got[4] == ["python"] or "python" in got[4]
    assert 5 not in got


def test_matches_reach_over_line_ends(spark):
    d = spark.createDataFrame([(1, "The job\nis done today.\nplain line\nBob works for\n\nAcme Corp"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.subject, r.predicate, r.object) for r in X.triples(d).collect()} == {("the job", "is", "done today."), ("bob", "works_for", "acme corp")}
    assert "The job\nis done today." in {r.content for r in X.memories(d).collect()}


def test_lessons_have_marks_signs_and_no_noise(spark):
    d = spark.createDataFrame([(1, "Decision: never restart the server by hand\n- вывод: всегда проверяй журнал ошибок\n----------------------\nshort"), (2, None)], "doc_id long, text string")
    assert [(r.lesson, r.score) for r in X.lessons(d).orderBy("line_no").collect()] == [("never restart the server by hand", 1.3), ("вывод: всегда проверяй журнал ошибок", 0.65)]
