"""The subpackage's operators: brute force, round trips, held-out accuracy, edge cases."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as C
from lodestone.llm import language as L
from lodestone.llm import leakage as K
from lodestone.llm import packing as P
from lodestone.llm import privacy as V
from lodestone.llm import truncation as X
from lodestone.sources.tables import read_table

DIR = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
MSG = "id string, session_id string, role string, created_at timestamp, content string, metadata_json string, d long"


def messages(spark, at, rows):
    return spark.createDataFrame([(i, s, r, at(t), c, m, 1) for i, s, r, t, c, m in rows], MSG)


# --- conversations


def test_verdicts_match_sql(spark):
    got = {r.session_id for r in C.p3_found(spark, DIR).collect()}
    con = duckdb.connect()
    con.sql(f"create view messages as select * from '{DIR}/messages.parquet'")
    assert got == {r[0] for r in con.sql(C.P3_SQL).fetchall()}


def test_reasons(spark, at):
    T = '{"turn": %d}'
    rows = [
        ("1", "ok", "Human", 1, "a", None), ("2", "ok", " bot", 2, "b", "{"), ("3", "blank", "user", 1, "​", None), ("4", "role", "user", 1, "a", None), ("5", "role", "???", 2, "a", None), ("6", "role", "ai", 3, "a", None),
        ("7", "late", "user", 1, "a", None), ("8", "bot1", "assistant", 1, "a", None), ("9", "gap", "user", 1, "a", T % 1), ("10", "gap", "assistant", 2, "a", T % 3), ("11", None, "user", 1, "a", None), ("12", "", "user", 1, "a", None),
        ("13", "skew", "user", 100, "a", T % 1), ("14", "skew", "assistant", 50, "b", T % 2), ("15", "skew", None, 60, " ", T % 3), ("16", "skew", "assistant", 70, "c", T % 4),
    ]
    df = messages(spark, at, rows + rows[:4])
    got = {r.session_id: r.reason for r in C.verdicts(df).collect()}
    assert got == {"ok": None, "blank": "empty", "role": "bad_role", "late": "no_reply", "bot1": "no_user_first", "gap": "turn_gap", "skew": None}
    skew = C.verdicts(df).where("session_id = 'skew'").first()
    assert skew.d < 0 and skew.clock_ok
    turns = {r.session_id: [(t.role, t.text) for t in r.turns] for r in C.conversations(df).collect()}
    assert turns == {"ok": [("user", "a"), ("assistant", "b")], "skew": [("user", "a"), ("assistant", "b"), ("assistant", "c")]}
    assert C.verdicts(messages(spark, at, [])).count() == 0


def test_offset_is_recovered(spark, at):
    rng = random.Random(1)
    rows, t = [], 1000
    for k in range(1, 41):
        t += rng.randint(50, 70)
        bot = k % 2 == 0
        rows.append((str(k), "s", "assistant" if bot else "user", t - 300 * bot, "x", '{"turn": %d}' % k))
    v = C.verdicts(messages(spark, at, rows)).first()
    assert v.clock_ok and abs(v.d / 1e6 + 300) < 10


def test_common_and_cued_names_and_national_phones():
    def found(t):
        return [(k, t[a:b]) for k, a, b, _ in V.mentions(t)]

    for name in ("Mary Brown", "William Scott", "Mary Elizabeth Brown", "Anna Li", "J. Lee", "J. R. Ito", "Ганна Шевченко"):
        assert found(f"Ask {name}, then go on.") == [("person", name)]
    assert found("Hello, my name is Zorvik Quentell.") == found("Write to Dr. Zorvik Quentell.") == [("person", "Zorvik Quentell")]
    assert found("You will mark later what was a joy or hope. Option B. Use it, or C. Run. Mark All as read. Grant Everyone a look.") == []
    for phone in ("030 1234567", "067 123 45 67", "06 12 34 56 78", "004930123456"):
        assert found(f"Call {phone} today") == [("phone", phone)]
    assert found("On 01.02.2024 at 06:12 we had 0.25 and 007 of 0012345 rows") == []

def test_messages_without_turn_stand_by_their_time(spark, at):
    T = '{"turn": %d}'
    rows = [("0", "s", "user", 1, "first", "{"), ("x", "s", "user", 25, "between", None), ("z", "s", "ai", 9000, "last", None)]
    rows += [(f"n{i}", "s", "ai" if i % 2 else "user", 10 * i, f"n{i}", T % i) for i in range(1, 601)]
    rows += [("y", "s", "user", 5555, "late", None)]
    # the numbered times fall back: 12 is later than one of them, so it does not come first
    rows += [("a", "b", "user", 20, "one", T % 1), ("b", "b", "ai", 10, "two", T % 2), ("c", "b", "user", 30, "three", T % 3), ("d", "b", "ai", 40, "four", T % 4), ("e", "b", "system", 35, "note", None)]
    got = {}
    for r in sorted(C.conversations(messages(spark, at, rows)).collect(), key=lambda r: r.part):
        got.setdefault(r.session_id, []).extend((t.pos, t.text) for t in r.turns)
    want = [f"n{i}" for i in range(1, 601)]
    want = ["first", *want[:2], "between", *want[2:555], "late", *want[555:], "last"]
    assert got["s"] == list(enumerate(want, 1))
    assert [t for _, t in got["b"]] == ["one", "two", "three", "note", "four"]


def test_offset_changes_the_order_without_turn_numbers(spark, at):
    """The assistant's clock is 30 s ahead in one session; in another no offset fits, in a third replies can't be paired."""
    times = {"ahead": ([100, 110, 200], [138, 148, 260]), "never": ([100, 110, 200, 300], [105, 106, 299, 360]), "unpaired": ([100, 110, 200], [120, 260]), "agree": ([100, 200], [110, 210])}
    rows = [(f"{s}{r}{i}", s, r, t, f"{r[0]}{i}", None) for s, two in times.items() for r, ts in zip(("user", "ai"), two, strict=True) for i, t in enumerate(ts)]
    df = messages(spark, at, rows)
    got = {r.session_id: [t.text for t in r.turns] for r in C.conversations(df).collect()}
    assert got == {"ahead": ["u0", "a0", "u1", "a1", "u2", "a2"], "unpaired": ["u0", "u1", "a0", "u2", "a1"], "agree": ["u0", "a0", "u1", "a1"]}
    assert {r.session_id for r in C.verdicts(df).where("reason is null").collect()} == set(times)
    off = {r.session_id: r for r in C.paired_offsets(C.prepared(df).select("session_id", "id", "role", "t")).collect()}
    assert 28e6 < off["ahead"].d < 38e6 and not off["never"].clock_ok and off["agree"].d == 0 and "unpaired" not in off


def test_order_matches_sql(spark):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view messages as select * from '{DIR}/messages.parquet'")
    cols = "session_id, pos, role, h, at_us"
    got = {tuple(r) for r in C.p3_order(spark, DIR).select(*cols.split(", ")).collect()}
    assert got and got == set(con.sql(f"select {cols} from ({C.P3_ORDER_SQL})").fetchall())


# --- truncation


def test_censored_fit_recovers_its_parameters():
    x = np.random.default_rng(3).normal(5.0, 0.5, 20000)
    lim = 200
    u = x[x < np.log(lim)]
    mu, sd = X.fit_censored(len(u), u.sum(), (u**2).sum(), len(x) - len(u), lim)
    assert abs(mu - 5) < 0.03 and abs(sd - 0.5) < 0.03


def test_truncated_texts(spark):
    rng = random.Random(5)
    subj, verb, obj = ["The cat", "A dog", "My aunt", "The old man"], ["sees", "paints", "sells", "moves"], ["the small red house", "a boat on the lake", "every green apple", "the wooden table"]
    full = [(" ".join(f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}." for _ in range(rng.randint(2, 12)))) for _ in range(1500)]
    rows = [(str(i), "a", t[:200], "x") for i, t in enumerate(full)] + [("none", "a", None, "x"), ("blank", "a", " ", "x"), ("null source", None, "A dog sees a boat on the la", "x")]
    s = spark.createDataFrame(rows + rows[:5], "id string, client string, user_prompt string, body string")
    r = spark.createDataFrame([], "session_id string, writer string, summary string")
    got = {x.rec_id for x in X.scored(s, r).where("posterior > 0.5").collect()}
    want = {str(i) for i, t in enumerate(full) if len(t) > 200}
    assert len(got & want) / len(want) > 0.95 and len(got - want - {"null source"}) <= 0.02 * len(full)
    assert "null source" in got and not got & {"none", "blank"}


def test_complete_texts_of_the_limits_length_are_no_cases(spark):
    """Cut texts at a limit are found, complete ones of just that length are not, nor is a text whose code span begins early."""
    rng = random.Random(6)
    subj, verb, obj = ["The cat", "A dog", "My aunt", "The old man"], ["sees", "paints", "sells", "moves"], ["the small red house", "a boat on the lake", "every green apple", "the wooden table"]
    one = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}"
    full = [". ".join(one() for _ in range(rng.randint(2, 12))) + "." for _ in range(1500)]
    rows = [(f"t{i}", "a", t[:200] if len(t) > 200 else t) for i, t in enumerate(full)]
    exact = []
    while len(exact) < 60:
        t = ". ".join(one() for _ in range(rng.randint(4, 7))) + "."
        exact += [t] * (len(t) == 200)
    rows += [(f"e{i}", "a", t) for i, t in enumerate(exact)]
    code = "`" + "x" * 20 + "` " + "A dog sees a boat. " * 8 + "My aunt paints the table :)"
    rows += [("code", "b", code), ("entity", "b", "A dog sees a boat on the lake. &am"), ("and", "b", "A dog sees a boat on the lake, and")]
    rows += [(f"p{i}", "b", f"{one()}, and {one()}." if i % 3 else f"{one()}.") for i in range(300)]
    rows += [(f"q{i}", "b", f"{one()}, and...") for i in range(5)]
    s = spark.createDataFrame(rows, "id string, client string, user_prompt string")
    r = spark.createDataFrame([], "session_id string, writer string, summary string")
    got = {x.rec_id for x in X.scored(s, r).where("posterior > 0.5").collect()}
    cut = {f"t{i}" for i, t in enumerate(full) if len(t) > 200 and t[:200].rstrip()[-1] != "."}
    assert len(got & cut) / len(cut) > 0.97 and not [x for x in got if x[0] == "e" and x != "entity"]
    assert {"entity", "and"} <= got and "code" not in got

def test_what_a_long_text_leaves_open(spark):
    code = "Run this:\n```\n" + "print(step)\n" * 30
    texts = {
        "fence": code + "print(step)", "whole": code + "```", "paren": "See (as of the [last] report " + "and the table of the day " * 10 + "with size [3]", "closed": "See (as of " + "and the day " * 20 + ") with size [3]",
        "quote": "He said «we go " + "and then we go " * 15 + "on", "row": "a\n|b|" + "c d " * 60 + "e",
    }
    df = spark.createDataFrame([("sessions", k, "x", t, len(t), len(t)) for k, t in texts.items()], "rec_table string, rec_id string, source string, text string, chars long, bytes long")
    assert {r.rec_id for r in X.features(df).where("kind = 'open'").collect()} == {"fence", "paren", "quote", "row"}


def test_a_source_that_cuts_nearly_every_text_has_a_limit(spark):
    rows = [("cut", 400)] * 60 + [("cut", 90)] * 2 + [("free", 50 + 17 * i % 900) for i in range(200)]
    df = spark.createDataFrame([("sessions", s, n, 0, n) for s, n in rows], "rec_table string, source string, chars long, body long, bytes long")
    assert {(r.source, r.measure, r.len) for r in X.limits(df).collect()} == {("cut", "chars", 400), ("cut", "bytes", 400)}



# --- privacy


CASES = [
    ("Ask Kofi Kestelmi about it.", [("person", 4)]), ("Запиши: ІПН 0068735464.", [("id_number", 12)]), ("see https://crm.invalid/find?mail=a.b43@post.example.org", [("email", 34)]),
    ("The remote is git@repo.invalid:memory/core.git here.", []), ("Use @cached on recall() in line 158.", []), ("Ticket 20798-11798 stays open. Build 4.18.412 took 412.5 seconds.", []), ("Street Map tiles are 222 px wide.", []),
    ("NI number QQ 37 01 45 B. Forward it", [("id_number", 10)]), ("Contact: Quillelmi, Wanda, Flat 17, 1526 Saffron Hill Close, Quenton Falls, +44 7700 900058", [("person", 9), ("address", 27), ("phone", 76)]),
    ("Клієнт: назар туниченко, вулиця Вербова 2, Зелений Яр", [("person", 8), ("address", 25)]), ("2026-03-17 10:27:00 10.0.184.12:8668", []), ("", []), ("This is Nadia Braskhurst's laptop.", [("person", 8)]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_mentions(text, want):
    assert [(k, a) for k, a, *_ in V.mentions(text)] == want


def test_surrogates_keep_entities_apart_and_together(spark):
    rows = [("t", str(i), f"Please call Kofi Brask{chr(97 + i % 26)}{chr(97 + i // 26)}sen back at +1-212-555-{i:04d}. Kofi Brask{chr(97 + i % 26)}{chr(97 + i // 26)}sen waits.") for i in range(300)] + [("t", "n", None), ("t", "p", "nothing here")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, text string")
    got = {r.rec_id: r for r in V.anonymised(df, "k").collect()}
    assert len(got) == 300 and got["7"].placeholder_text.startswith("Please call [PERSON_")
    names = {}
    for i, r in got.items():
        a = r.surrogate_text.removeprefix("Please call ").split(" back at ")
        again = a[1].split(". ", 1)[1].removesuffix(" waits.")
        assert a[0] == again and "Brask" not in r.surrogate_text and V.GENDER[a[0].split()[0].lower()] == "m"
        names[i] = a[0]
    assert len(set(names.values())) == 300
    assert V.anonymised(df.where("false"), "k").count() == 0


def test_distinct_entities_stay_distinct_in_their_form(spark):
    rows = [("t", str(i), f"passport {i * 7:05d}. Mail a{i}@b.org, call +49 30 {1000000 + i * 13}, or A. Brask{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}sen.") for i in range(6000)]
    got = [r.surrogate_text for r in V.anonymised(spark.createDataFrame(rows, "rec_table string, rec_id string, text string"), "k").collect()]
    for form in (r"passport (\d{5})\.", r"Mail (\S+),", r"call (\+49 30 \d{7}),", r", or (\w\. \S+)\.$"):
        assert len({re.search(form, t)[1] for t in got}) == 6000
    assert len({V.ranked("address", "12 Bardenfal Street", i) for i in range(1, 600)}) == 599


def test_addresses_keep_the_form_of_their_language():
    forms = {"Hauptstraße 5": r"\w+straße \d+", "12 rue de la Paix": r"\d+ rue \w+", "Calle Mayor, 3": r"Calle \w+, \d+", "ul. Długa 7": r"ul\. \w+ \d+", "вул. Садова, буд. 5": r"вул\. \w+, буд\. \d+, кв\. \d+", "ул. Садовая, д. 5": r"ул\. \w+, д\. \d+, кв\. \d+", "12 Mill Lane": r"\d+ \w+ Street"}
    for a, form in forms.items():
        (kind, _, _, norm), = V.mentions(f"Send it to {a} today")
        assert kind == "address" and re.fullmatch(form, V.surrogate(kind, norm, 0, b"k")), a
    assert V.shaped("0049 30 1234567", "phone", V.surrogate("phone", "49301234567", 0, b"k")).startswith("0049 30 ")


def test_inflected_rare_and_lower_case_names():
    for text, name, norm in (
        ("Gertrude Whitaker called", "Gertrude Whitaker", "gertrude whitaker"), ("Bernadette Kowalczyk is in", "Bernadette Kowalczyk", "bernadette kowalczyk"), ("Oluwaseun Adeyemi said", "Oluwaseun Adeyemi", "oluwaseun adeyemi"),
        ("письмо Геннадия Воробьёва", "Геннадия Воробьёва", "геннадий воробьёв"), ("отдай Ивану Петрову", "Ивану Петрову", "иван петров"), ("ask anna schmidt about it", "anna schmidt", "anna schmidt"),
    ):
        assert [(k, text[a:b], n) for k, a, b, n in V.mentions(text)] == [("person", name, norm)]
    assert [(k, a, b) for k, a, b, _ in V.mentions("to 12 rue Victor Hugo, Paris")] == [("address", 3, 28)]


def test_names_are_learned_from_the_corpus(spark):
    """Zorvik stands before two family names that are known from listed given names, Project before one and other words."""
    rows = ["Anna Quentell and Paul Quentell came.", "Maria Bravik wrote to Olga Bravik.", "Then Zorvik Quentell left.", "We met Zorvik Bravik.", "Now Zorvik Unseen is here.", "See Project Quentell and Project Alpha, Project Beta.", "ask anna bravik or anna said"]
    df = spark.createDataFrame([("t", str(i), x) for i, x in enumerate([*rows, None, ""])], "rec_table string, rec_id string, text string")
    got = {(r.rec_id, r.norm) for r in V.detected(df.unionByName(df)).collect()}
    assert {n for i, n in got if i in "2345"} == {"zorvik quentell", "zorvik bravik", "zorvik unseen"}
    assert ("6", "anna bravik") in got and ("6", "anna said") not in got


def test_no_surrogate_is_an_entity_of_the_run(spark):
    """A tenth of all numbers of five digits are real, and half of those of four: there they only stay distinct."""
    df = spark.createDataFrame([("id_number", f"{i:05d}") for i in range(0, 100000, 10)] + [("id_number", f"{i:04d}") for i in range(5000)], "kind string, norm string")
    got = [(r.norm, r.s) for r in V.surrogates(df, "k").collect()]
    assert len(got) == len({s for _, s in got}) == 15000
    assert not {s for _, s in got if len(s) == 5} & {n for n, _ in got}


# --- packing


def test_packing_is_whole_and_fits(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 400)) for i in range(1, 300)] + [(None, "a b c"), (900, None), (901, ""), (902, "long " * 3000), (5, "word " * 35)], "doc_id long, text string").withColumn("tokens", F.lit(1))
    got = P.pack(docs, [256, 64, None, 1024, 0], shard_items=80).collect()
    n = {}
    for r in P.token_counts(docs).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.tokens
    held, size = {}, {}
    for r in got:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
        if r.container:
            size.setdefault((r.container, r.capacity), []).append(r.tokens)
    assert held == n and all(sum(v) <= c for (_, c), v in size.items())
    assert len({k for k, _ in size}) == len(size)
    assert sum(len([r for r in got if r.doc_id == i]) for i in range(1, 300) if i != 5) == 298
    assert P.pack(docs.where("false"), [64]).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs, [None])


def test_little_room_is_lost():
    sizes = np.sort(np.random.default_rng(1).integers(1, 900, 5000))[::-1]
    where, caps = P.best_fit(sizes, [256, 1024, 4096])
    assert sizes.sum() / caps.sum() > 0.999 and len(where) == 5000


def test_sizes_decide_on_capacities_jointly():
    """Room that a small capacity fills exactly is not opened large, and several capacities are used."""
    sizes = np.sort(np.minimum(np.exp(np.random.default_rng(3).normal(5, 1.2, 2000)).astype(int) + 1, 4096))[::-1]
    where, caps = P.best_fit(sizes, [512, 1024, 2048, 4096])
    held = np.bincount(where, weights=sizes)
    assert (held <= caps).all() and min((caps == c).sum() for c in (1024, 2048, 4096)) > 5 and sizes.sum() / caps.sum() > 0.999
    _, caps = P.best_fit(np.array([700] * 4 + [324] * 4), [1024, 4000])
    assert sorted(caps) == [1024] * 4


# --- leakage


def shingles(ws):
    n = min(len(ws), K.SHINGLE)
    return K.shingle_hashes(K.word_hashes(ws), n).tolist() if n else []


def test_leaks_match_brute_force(spark):
    """Every document against every item: each passage of twice the item's length that begins at a shared shingle."""
    docs, items = read_table(spark, SF01, "documents"), read_table(spark, SF01, "eval_items")
    got = {(r.doc_id, r.item_id) for r in K.p7_found(spark, SF01).collect()}
    index = {r.item_id: (list(r.words), set(r.rare or []), list(r.sh)) for r in K.item_index(items).collect()}
    want = set()
    for d in docs.select("doc_id", "text").collect():
        places = list(enumerate(shingles(K.words(d.text))))
        for i, (q, r, sh) in index.items():
            known = set(sh)
            own = [(p, x) for p, x in places if x in known]
            passages = [[x for p, x in own if at <= p < at + 2 * len(q)] for at, _ in own]
            if passages:
                part, share, rare = K.repeated(q, r, sh, passages)
                if part >= K.CONTAINED and share >= K.SHARE and rare >= K.RARE_SHARE:
                    want.add((d.doc_id, i))
    assert want and len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.02 * len(got)


def leaked(docs, items):
    return {(r.doc_id, r.item_id) for r in K.leaks(docs, items).where(f"contained >= {K.CONTAINED} and share >= {K.SHARE} and rare_share >= {K.RARE_SHARE}").collect()}


def test_leak_edges(spark):
    q = "In spring the baker Rukclapex hid 703 orange buoys behind the chapel in Kernauzorruk for the price of a donkey"
    items = spark.createDataFrame([(1, q, "x"), (2, None, "x"), (3, "violet teapot", "x"), (4, "Zanzibar?", "x"), (5, "...", "x"), (None, q, "x")], "item_id long, question string, words string")
    docs = spark.createDataFrame([(1, "noise " * 50 + q.upper().replace(" ", "\n* ") + " tail" * 50), (2, None), (3, " "), (4, q[:30]), (5, "in spring the baker"), (6, "a Violet  *teapot* on its own"), (7, "to ZANZIBAR by sea"), (8, "violet or teapot"), (None, q), (1, "noise " * 50 + q)], "doc_id long, text string")
    got = leaked(docs, items)
    assert got == {(1, 1), (6, 3), (7, 4)}
    assert K.leaks(docs, items.where("false")).count() == 0 and K.leaks(docs.where("false"), items).count() == 0


def test_leaks_without_rare_words(spark):
    q = "In spring the baker Rukclapex hid 703 orange buoys behind the chapel in Kernauzorruk for the price of a donkey"
    sums = [f"A farmer sells {a} eggs on the first day and {b} on the second one how many eggs did the farmer sell in all" for a, b in ((4821, 77), (915, 3302), (64, 2718), (5150, 811), (1999, 36))]
    items = spark.createDataFrame([*((i, q) for i in (1, 2, 3, 4)), *enumerate(sums, 11)], "item_id long, question string")
    docs = spark.createDataFrame([(1, "noise " * 50 + q + " tail" * 50), (2, "noise " * 50 + sums[1] + " tail" * 50)], "doc_id long, text string")
    got = leaked(docs, items)
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 12)}


def test_long_items_have_partitions_of_their_own(spark):
    rng = random.Random(5)
    q = " ".join(f"word{rng.randrange(10**6)}" for _ in range(2000))
    items = spark.createDataFrame([(1, q), (2, "some other question about nothing much")], "item_id long, question string")
    docs = spark.createDataFrame([(1, "noise " * 3000 + " ".join(q.split()[:1300]) + " tail" * 3000), (2, " ".join(q.split()[:300]))], "doc_id long, text string")
    assert K.window_size(K.size_class(2000)) >= 2000
    assert leaked(docs, items) == {(1, 1)}


def parts(item, *passages):
    sh = shingles(item)
    return K.repeated(item, {"w0", "w1"}, sh, [shingles(p) for p in passages])


def test_names_count_over_both_passages():
    item = [f"w{i}" for i in range(20)]
    assert parts(item, item[:5], ["x", *item[10:16]]) == (7 / 18, 11 / 20, 1.0)
    assert K.repeated(item, set(), shingles(item), [shingles(item)]) == (1.0, 1.0, 1.0)


def test_other_part_behind_many_copies_of_one():
    item = [f"w{i}" for i in range(30)]
    assert parts(item, *([f"x{i}", *item[:9]] for i in range(12)), item[20:28]) == (13 / 28, 17 / 30, 1.0)


# --- language


def test_held_out_samples(spark):
    rows = [(r.lang, r.text) for r in read_table(spark, SF01, "lang_samples").collect()]
    random.Random(2).shuffle(rows)
    cut = len(rows) // 2
    scorer = L.Scorer(L.Model(L.counted(rows[:cut])))
    got = [ls[0][0] if ls else None for ls, _ in L.judged([t for _, t in rows[cut:]], scorer)]
    assert np.mean([a == b for a, (b, _) in zip(got, rows[cut:], strict=True)]) >= 0.95


def test_mixed_marked_and_odd_texts(spark):
    samples = read_table(spark, SF01, "lang_samples")
    docs = spark.createDataFrame(
        [(1, "user: The vector index checks the oldest lessons without any warning.\nassistant: Обход графа удаляет один и тот же абзац дважды.", "EN", "x"), (2, None, "en", "x"), (3, "​ \n", None, "x"), (4, "THE VECTOR INDEX CHECKS THE OLDEST LESSONS.", "und", "x"), (5, "```\nselect a from b\n```", "en", "x"), (6, "Сервер пам'яті видаляє зв'язки між двома сутностями.", "Ukrainian", "x")],
        "doc_id long, text string, lang string, main string",
    )
    got = {r.doc_id: r for r in L.languages(docs, L.fit(samples)).collect()}
    assert {x.lang for x in got[1].langs} == {"en", "ru"} and [s.lang for s in got[1].segments] == ["en", "ru"]
    assert got[4].main == "en" and got[4].label is None and got[6].main == got[6].label == "uk"
    assert got[2].main is None and got[3].main is None and got[5].main is None
    assert L.languages(docs.where("false"), L.fit(samples)).count() == 0
