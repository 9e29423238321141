"""Attribute history and intervals: brute force, edge cases, empty tables, clashing columns."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators.history import combined_history, found_versions
from lodestone.operators.intervals import found_periods

FACTS = "seq long, subject string, predicate string, object string, action string, observed_at timestamp, created_at timestamp, s string, b long"
TRIPLES = "subject string, predicate string, object string, valid_from timestamp, valid_to timestamp, s string, f long"
WEEK = 7 * 86400


def facts(spark, at, rows):
    return spark.createDataFrame([(q, s, p, o, a, at(t), at(c), "x", 1) for q, s, p, o, a, t, c in rows], FACTS)


def brute_versions(rows):
    out = set()
    keys = {}
    for q, s, p, o, a, t, c in rows:
        t = c if t is None else t
        if s and p and o and s.strip() and o.strip() and t is not None and a and a.strip().lower() in ("assert", "retract"):
            n = lambda x: " ".join(x.split()).lower()
            keys.setdefault((n(s), n(p)), set()).add((t, q, n(a), n(o)))
    for (s, p), es in keys.items():
        held, since, spans = None, None, []
        for t, _, a, o in sorted(es):
            if a == "assert":
                if held is not None:
                    spans.append((held, since, t))
                held, since = o, t
            elif held == o:
                spans.append((held, since, t))
                held = None
        if held is not None:
            spans.append((held, since, 0))
        joined = []
        for o, a, b in (x for x in spans if x[1] != x[2]):
            if joined and joined[-1][0] == o and joined[-1][2] == a:
                joined[-1][2] = b
            else:
                joined.append([o, a, b])
        out |= {(s, p, o, a, b) for o, a, b in joined}
    return out


event = st.tuples(st.integers(1, 30), st.sampled_from(["A", "a ", None, "B"]), st.sampled_from(["works_for", "Works_For"]), st.sampled_from(["x", "X", "y", None, " "]), st.sampled_from(["assert", "Assert ", "retract", "update", None]), st.sampled_from([None, 1, WEEK, WEEK + 5, 3 * WEEK, 3 * WEEK + 1]), st.sampled_from([2, 2 * WEEK]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(event, max_size=14, unique_by=lambda r: r[0]))
def test_versions_match_a_fold(spark, at, rows):
    got = {tuple(r) for r in found_versions(facts(spark, at, rows + rows[:2]), ["works_for"]).collect()}
    assert got == brute_versions(rows)


def test_no_facts(spark, at):
    assert found_versions(facts(spark, at, []), ["works_for"]).count() == 0
    assert combined_history(facts(spark, at, []), ["works_for"]).count() == 0


def test_combined_history_splits_at_every_boundary(spark, at):
    rows = [(1, "A", "p", "x", "assert", 10, 0), (2, "A", "q", "u", "assert", WEEK * 2, 0), (3, "A", "p", "y", "assert", WEEK * 4, 0), (4, "A", "q", "u", "retract", WEEK * 5, 0)]
    got = sorted(map(tuple, combined_history(facts(spark, at, rows), ["p", "q"]).select("p", "q", "from_s", "to_s").collect()), key=lambda r: r[2])
    assert got == [("x", None, 10, WEEK * 2), ("x", "u", WEEK * 2, WEEK * 4), ("y", "u", WEEK * 4, WEEK * 5), ("y", None, WEEK * 5, 0)]


def brute_periods(rows):
    out, keys = set(), {}
    for s, p, f, t in rows:
        if s and p and f is not None and (t is None or t > f):
            keys.setdefault((" ".join(s.split()).lower(), p), []).append((f, float("inf") if t is None else t))
    for (s, p), xs in keys.items():
        merged = []
        for f, t in sorted(xs):
            if merged and f <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([f, t])
        out |= {(s, p, "period", f, 0 if t == float("inf") else t) for f, t in merged}
        out |= {(s, p, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return out


interval = st.tuples(st.sampled_from(["A", "a", None, "B"]), st.just("p"), st.one_of(st.none(), st.integers(0, 60).map(lambda d: d * 86400)), st.one_of(st.none(), st.integers(0, 70).map(lambda d: d * 86400)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(interval, max_size=14))
def test_periods_match_a_sweep(spark, at, rows):
    df = spark.createDataFrame([(s, p, "o", at(f), at(t), "x", 1) for s, p, f, t in rows + rows[:3]], TRIPLES)
    assert {tuple(r) for r in found_periods(df).collect()} == brute_periods(rows)
