"""Stored rows, files, context: edge cases, brute force, and a core without the optional package."""

import subprocess
import sys

from pyspark.sql import functions as F

from lodestone.operators import context as C
from lodestone.operators import store as W
from lodestone.sources import files as Y


def test_core_is_there_without_the_optional_package_or_its_libraries():
    code = "import sys\nfor m in ('xxhash', 'ahocorasick', 'tiktoken'): sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 130 and 'bm25_topk' in q and 'p1_found' in q and not any(k.startswith('p2') for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_folder_scan_change_and_prune(spark, tmp_path):
    for name, data in {"a.md": b"# T\ntext", "sub/b.txt": "текст".encode(), "c.bin": b"x\x00y", "d.md": b"\xff\xfe" * 9, "big.md": b"x" * 900, "skip.secret": b"s"}.items():
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(data)
    x = Y.folder(spark, f"{tmp_path}/f").withColumn("path", F.substring_index("path", "/f/", -1))
    scan = Y.scanned(x, ["*.secret"], 500)
    got = {r.path for r in scan.collect()}
    assert "a.md" in got and "sub/b.txt" in got and not got & {"c.bin", "big.md", "skip.secret"}
    assert {r.path for r in Y.scanned(x, extensions=["txt"]).collect()} == {"sub/b.txt"}
    index = scan.select("path", "modified", "length").where("path <> 'a.md'").unionByName(scan.select(F.lit("gone.md").alias("path"), "modified", "length").limit(1))
    assert {r.path for r in Y.changed(scan, index).collect()} == {"a.md"} and {r.path for r in Y.missing(index, x).collect()} == {"gone.md"}
    p = {r.path: (r.format, r.title, r.body) for r in Y.parsed(scan.select("path", F.col("content").cast("string").alias("text"))).collect()}
    assert p["a.md"] == ("markdown", "T", "T\ntext") and p["sub/b.txt"] == ("text", "текст", "текст")


def test_globs_and_imports(spark):
    df = spark.createDataFrame([("/a/b.py", "from c.d import x\nimport os"), ("c/d.py", None), ("c/e/__init__.py", "  import c.d")], "path string, text string")
    assert {r.path for r in df.where(Y.denied(F.col("path"), ["a/*", "c/[!d]*"])).collect()} == {"/a/b.py", "c/e/__init__.py"}
    assert {(r.path, r.target) for r in Y.import_edges(df).collect()} == {("/a/b.py", "c/d.py"), ("c/e/__init__.py", "c/d.py")}


def test_import_modes_and_locks(spark):
    old = spark.createDataFrame([("a", "1", True), ("b", "2", False), ("c", None, None), (None, "x", False)], "key string, value string, locked boolean")
    new = spark.createDataFrame([("a", "9"), ("b", "token: abc"), ("d", "4"), ("d", "5"), (None, "y")], "key string, value string")
    got = lambda **k: {r.key: (r.value, r.action) for r in W.imported(old, new, **k).collect()}
    assert got() == {"a": ("1", "skipped"), "b": ("2", "skipped"), "c": (None, "kept"), "d": ("5", "added")}
    assert got(mode="replace") == {"a": ("1", "skipped_locked"), "b": ("token=<REDACTED>", "updated"), "c": (None, "kept"), "d": ("5", "added")}
    assert got(mode="replace", override_locked=True)["a"] == ("9", "updated")


def test_feedback(spark):
    rows = [(1, "coffee is not tea"), (2, "I work at Acme, really"), (3, "hello"), (4, None), (5, "сахар не хочу"), (6, "not this")]
    got = {r.id: (r.key, r.value) for r in W.feedback(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[1] == ("coffee_is", "false") and got[2] == ("work_at_acme,_really", "work at Acme") and got[5] == ("сахар", "хочу") and not set(got) & {3, 4}


def test_erasure_and_json(spark):
    users = spark.createDataFrame([("u",), (None,)], "session_id string")
    df = spark.createDataFrame([("u", "t"), ("v", "t"), (None, "t")], "session_id string, title string")
    assert {r.session_id for r in W.erasure({"x": (df, "session_id")}, users)["x"].collect()} == {"v", None}
    assert {r.session_id for r in W.pseudonymous(df, users, "session_id").collect()} == {"[DELETED]", "v", None}
    assert [r.title for r in W.anonymous(df, users, "session_id", ["title"]).orderBy("session_id").collect()] == ["t", "[ANONYMIZED]", "t"]
    j = spark.createDataFrame([('{"a": NaN, "b": [-Infinity, 1], "c": "NaN"}',)], "j string")
    assert j.select(W.clean_json(F.col("j")).alias("r")).first().r == '{"a": null, "b": [null, 1], "c": "NaN"}'


def brute_pack(hits, budget, share, cap, tail):
    def bucket(hs, room):
        paths, parts, used = list(dict.fromkeys(h["path"] or "(no-path)" for h in hs)), [], 0
        for turn in range(cap):
            for p in paths:
                mine = [h for h in hs if (h["path"] or "(no-path)") == p]
                if turn < len(mine):
                    h = mine[turn]
                    b = f"[{h['source']} score={h['score']:.4f} path={h['path'] or ''}]\n{h['text']}\n"
                    if used + len(b) > room:
                        cut = b[: room - used] if room - used > tail else ""
                        return parts + [cut] * bool(cut), used + len(cut)
                    parts.append(b)
                    used += len(b)
        return parts, used

    mem, used = bucket([h for h in hits if h["source"] not in C.WORKSPACE], int(budget * share))
    work, _ = bucket([h for h in hits if h["source"] in C.WORKSPACE], budget - used)
    return "\n\n".join("\n".join(p).strip() for p in (mem, work) if p)


def test_packing_is_a_fold(spark):
    rows = [(1, ["lessons", "hybrid", "stm", "prefs"][i % 4], str(i), None if i % 5 == 0 else f"p{i % 3}", "x" * (37 * i % 260 + 5), 9.0 - i / 7) for i in range(24)]
    df = spark.createDataFrame(rows, "qid long, source string, id string, path string, text string, score double")
    g = C.gathered(df)
    hits = [r.asDict() for r in g.orderBy("pos").collect()]
    for budget in (600, 1500, 4000):
        assert C.packed(g, budget).first().context == brute_pack(hits, budget, 0.35, 2, 80)
    assert C.packed(g.where("false")).count() == 0


def test_excerpts(spark):
    t = "\n".join(f"line {i}" for i in range(1, 13))
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    got = [r.r for r in df.select(C.excerpt(F.col("t"), F.lit(60), F.lit(66), numbered=True).alias("r")).collect()]
    assert got == [" 9: line 9\n10: line 10", "", ""]
