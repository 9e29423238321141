"""Evaluation items that leak into a corpus (problem 7): size-partitioned MinHash containment, then exact shingle containment.

Items are partitioned by their number of words, on a grid without end. For each partition, documents are cut into
overlapping windows of about that size, so that the containment of an item in a window turns into a Jaccard similarity
that MinHash can see: with item size q and window size w, J = c q / (q + w - c q). Windows and items meet by an
equi-join on (partition, permutation, minimum), and the number of equal minima estimates the containment. Every pair
that reaches the partition's threshold is verified by exact containment of the item's shingles in the document's
passages. Items of one or two words are one shingle of their own length, and their windows are the runs of that length.

TESTDATA.md asks for half of an item's words, in one or two passages, with changed and missing words: shingles are
three words and the thresholds are LEAST, CONTAINED and SHARE, not five words and 0.8.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import VISIBLE
from lodestone.llm.language import MIXED, WORD, _one_script, fold
from lodestone.sources.tables import checkpointed, read_table, spread

SHINGLE = 3
HASHES = 64
LEAST = 0.12  # containment of an item in one window from which the pair is verified
CONTAINED = 0.4  # share of an item's shingles that a document must hold: each changed word takes three of them away
SHARE = 0.5  # words of an item that these shingles must cover
RARE_SHARE = 0.34  # names and numbers of an item that must be among them
FIRST_SIZE, RATIO = 16, 1.5  # upper bound of the first partition in words, and of each next one to the one before
LOOK_BITS = 22  # a partition's bitmap of known shingles, and that of known minima, have 2**LOOK_BITS bits at any number of items
GROUP_WORDS = 400_000  # words of the texts that are worked on together; a longer text is one group

SPLIT = re.compile(r"(?<=\w)[-‐]\n\s*(?=[^\W\d_])")
TOKEN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without regard to case, accents, punctuation, markup, line breaks and invisible or look-alike letters."""
    if not text:
        return []
    t = fold(SPLIT.sub("", text) if "-\n" in text or "‐\n" in text else text)
    if not t.isascii() and MIXED.search(t):
        t = WORD.sub(_one_script, t)
    return TOKEN.findall(t)


def size_class(n: int) -> int:
    """Partition of items of n words: -1 and -2 for one and two words, else the first whose bound is not below n."""
    if n < SHINGLE:
        return -n
    c = 0
    while window_size(c) < n:
        c += 1
    return c


def window_size(c: int) -> int:
    return -c if c < 0 else int(FIRST_SIZE * RATIO**c)


_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**62, HASHES, dtype=np.uint64)
_C = _RNG.integers(1, 2**62, (SHINGLE + 1, SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    if not ws:
        return np.empty(0, np.uint64)
    ids, distinct = pd.factorize(np.array(ws, dtype=object))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[ids]


def shingle_hashes(h: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """62-bit hashes of the runs of so many words."""
    n = len(h) - length + 1
    if n < 1:
        return np.empty(0, np.int64)
    x = np.zeros(n, np.uint64)
    for i in range(length):
        x += h[i : i + n] * _C[length, i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(2)).astype(np.int64)


def permuted(sh: np.ndarray, k: int) -> np.ndarray:
    """Places of the shingles in the k-th permutation, in 32 bits."""
    return ((sh.astype(np.uint64) * _A[k] + _B[k]) >> np.uint64(32)).astype(np.int64)


def signature(sh: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of shingle hashes."""
    return np.array([permuted(sh, k).min() for k in range(HASHES)], np.int64)


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        rows = []
        for i, q in zip(d["item_id"], d["question"], strict=True):
            ws = words(q)
            if ws:
                sh = shingle_hashes(word_hashes(ws), min(len(ws), SHINGLE))
                rows.append((i, ws, size_class(len(ws)), len(sh), sh.tolist(), signature(sh).tolist()))
        yield pd.DataFrame(rows, columns=["item_id", "words", "cls", "n", "sh", "sig"])


def item_index(items: DataFrame) -> DataFrame:
    """item_id, words, cls (size partition), n (shingles), sh (their hashes in order), sig (minima), and rare: the words that hardly another question has."""
    x = items.where("item_id is not null").select("item_id", "question").distinct().mapInPandas(_items, "item_id bigint, words array<string>, cls int, n int, sh array<bigint>, sig array<bigint>")
    # one question under several ids counts once
    df = x.select("words").distinct().select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    one = x.select("item_id", F.explode(F.array_distinct("words")).alias("w")).join(df.where("df <= 3 or w rlike '^[0-9]+$'"), "w")
    return x.join(one.groupBy("item_id").agg(F.collect_set("w").alias("rare")), "item_id", "left")


def _bit(c):
    """Place of a shingle or minimum in the bitmaps, from 1."""
    return F.pmod(c, F.lit(1 << LOOK_BITS)) + 1


def bitmaps(index: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """For each size partition the bitmap of its items' shingles, that of their minima, and the least number of shingles.

    Bitmaps are built by an aggregate and have the same size for any number of items; they only get fuller.
    """
    least = {r.cls: r.n for r in index.groupBy("cls").agg(F.min("n").alias("n")).collect()}
    both = index.select("cls", F.lit(0).alias("kind"), F.explode("sh").alias("v")).unionByName(index.select("cls", F.lit(1).alias("kind"), F.explode("sig").alias("v")))
    parts = both.select("cls", "kind", _bit(F.col("v")).alias("b")).groupBy("cls", "kind", F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = {c: (np.zeros(1 << LOOK_BITS, bool), np.zeros(1 << LOOK_BITS, bool), n) for c, n in least.items()}
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        out[r.cls][r.kind][(r.bucket - 1) * len(bits) : r.bucket * len(bits)] = bits
    return out


def equal_minima(n, m):
    """Equal minima asked of an item of n and a window of m shingles: with containment c, J = c n / (n + m - c n)."""
    return 0.6 * HASHES * LEAST * n / (n + m)


def _group_windows(ids: list, sizes: list[int], h: np.ndarray, look: dict) -> list[tuple]:
    """Windows of a group of texts (numbers of words and word hashes one after another) that an item may be found in."""
    rows: list[tuple] = []
    mask = (1 << LOOK_BITS) - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    by_length = {L: shingle_hashes(h, L) for L in {SHINGLE if c >= 0 else -c for c in look}}
    for c, (known, minima, least) in look.items():
        length = SHINGLE if c >= 0 else -c
        sh = by_length[length]
        if not len(sh):
            continue
        hit = np.append(known[sh & mask], np.zeros(len(h) - len(sh), bool))
        upto = np.concatenate([[0], np.cumsum(hit)])
        last = np.maximum(ends - length + 1, starts)  # shingles of a text end here
        full = upto[last] > upto[starts]
        size = max(window_size(c) - length + 1, 1)
        step = max(window_size(c) // 2, 1)
        many = np.where(full, np.maximum(-(-(last - starts) // step), 1), 0)
        doc = np.repeat(np.arange(len(sizes)), many)
        if not len(doc):
            continue
        win = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        a = starts[doc] + win * step
        b = np.minimum(a + size, last[doc])
        # equal minima come from a shared shingle only, so a window without any is no hit of the search either
        some = upto[b] > upto[a]
        doc, win, a, b = doc[some], win[some], a[some], b[some]
        if not len(doc):
            continue
        m = b - a
        at = np.cumsum(m) - m
        inside = sh[np.arange(m.sum()) + np.repeat(a - at, m)]
        sig = np.stack([np.minimum.reduceat(permuted(inside, k), at) for k in range(HASHES)], 1)
        match = minima[sig & mask]
        near = match.sum(1) >= np.maximum(equal_minima(least, m), min(2.0, size))
        for i in np.flatnonzero(near):
            x, y = max(a[i] - step, starts[doc[i]]), min(b[i] + step, last[doc[i]])
            around = sh[x:y][hit[x:y]]
            ks = np.flatnonzero(match[i])
            rows.append((ids[doc[i]], c, int(win[i]), int(m[i]), ks.tolist(), sig[i, ks].tolist(), np.unique(around).tolist()))
    return rows


WINDOW = "doc_id bigint, cls int, win int, m int, ks array<int>, vs array<bigint>, sh array<bigint>"


def windows(docs: DataFrame, look: dict) -> DataFrame:
    """Windows with minima that an item may have: doc_id, cls, win, m (shingles), ks and vs (permutations and minima), sh
    (the window's shingles, and those of a margin on both sides, that an item may have)."""
    shared = docs.sparkSession.sparkContext.broadcast(look)
    names = [c.split()[0] for c in WINDOW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ids, sizes, flat = [], [], []
            for i, text in zip(d["doc_id"], d["text"], strict=True):
                ws = words(text)
                ids.append(i)
                sizes.append(len(ws))
                flat += ws
                if len(flat) >= GROUP_WORDS:
                    yield pd.DataFrame(_group_windows(ids, sizes, word_hashes(flat), shared.value), columns=names)
                    ids, sizes, flat = [], [], []
            yield pd.DataFrame(_group_windows(ids, sizes, word_hashes(flat), shared.value), columns=names)

    x = docs.where("doc_id is not null").where(F.col("text").rlike(VISIBLE)).select("doc_id", "text")
    return spread(x).mapInPandas(run, WINDOW)


def bits(places) -> int:
    return sum(1 << i for i in places)


def widest(sets: Iterable[int]) -> list[int]:
    """The sets that are not part of another one, each once: no pair of the others covers more than theirs."""
    out: list[int] = []
    for x in sorted(set(sets), key=int.bit_count, reverse=True):
        if not any(x | y == y for y in out):
            out.append(x)
    return out


def repeated(item: list[str], rare: set[str], sh: list[int], passages: Iterable[Iterable[int]]) -> tuple[float, float, float]:
    """Exact containment of an item's shingles in the best one or two passages, the share of its words that they cover,
    and of its names and numbers. An item without names and numbers has them all."""
    length = len(item) - len(sh) + 1
    named = bits(i for i, w in enumerate(item) if w in rare)
    best = (False, 0.0, 0.0, 0.0)
    held = []
    for p in passages:
        p = set(p)
        held.append(bits(i for i, s in enumerate(sh) if s in p))
    held = widest(held)
    for i, x in enumerate(held):
        for y in held[i:]:
            z = x | y
            covered = z
            for k in range(1, length):
                covered |= z << k
            got = (z.bit_count() / len(sh), covered.bit_count() / len(item), (covered & named).bit_count() / named.bit_count() if named else 1.0)
            best = max(best, (got[0] >= CONTAINED and got[1] >= SHARE and got[2] >= RARE_SHARE, *got))
    return best[1:]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        got = [repeated(list(q), set(r) if r is not None else set(), list(s), ps) for q, r, s, ps in zip(d["item"], d["rare"], d["sh"], d["passages"], strict=True)]
        yield pd.DataFrame({"doc_id": d["doc_id"], "item_id": d["item_id"], "contained": [x for x, _, _ in got], "share": [y for _, y, _ in got], "rare_share": [z for _, _, z in got]})


LEAKS = "doc_id bigint, item_id bigint, contained double, share double, rare_share double"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, contained, share, rare_share of every pair that the search brings up, verified on shingles.

    Whole texts are searched, items of any length. Null and blank texts and items without words are left out. Repeated
    rows change nothing; empty tables give no rows; further columns are ignored. Only window numbers, minima and the
    shingles shared with some item leave the scan of the texts.
    """
    index = checkpointed(item_index(items))
    look = bitmaps(index)
    if not look:
        return docs.sparkSession.createDataFrame([], LEAKS)
    found = checkpointed(windows(docs, look))
    bands = found.select("doc_id", "cls", "win", "m", F.explode(F.arrays_zip("ks", "vs")).alias("x")).select("doc_id", "cls", "win", "m", F.col("x.ks").alias("k"), F.col("x.vs").alias("v"))
    keys = index.select("item_id", "cls", "n", F.posexplode("sig").alias("k", "v"))
    asked = F.greatest(equal_minima(F.col("n"), F.col("m")), F.when(F.col("cls") < 0, 1.0).otherwise(2.0))
    hits = bands.join(keys, ["cls", "k", "v"]).groupBy("doc_id", "cls", "win", "m", "item_id", "n").agg(F.countDistinct("k").alias("equal")).where(F.col("equal") >= asked)
    shared = hits.select("doc_id", "cls", "win", "item_id").join(found.select("doc_id", "cls", "win", F.col("sh").alias("held")), ["doc_id", "cls", "win"]).join(index.select("item_id", "sh"), "item_id")
    pairs = shared.select("doc_id", "item_id", F.array_sort(F.array_intersect("held", "sh")).alias("p")).groupBy("doc_id", "item_id").agg(F.collect_set("p").alias("passages"))
    whole = pairs.join(index.select("item_id", F.col("words").alias("item"), "rare", "sh"), "item_id")
    return whole.select("doc_id", "item_id", "item", "rare", "sh", "passages").mapInPandas(_verify, LEAKS)


def p7_found(spark, sf_dir):
    """Documents with the evaluation items that they contain."""
    x = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return x.where((F.col("contained") >= CONTAINED) & (F.col("share") >= SHARE) & (F.col("rare_share") >= RARE_SHARE)).select("doc_id", "item_id").distinct()


def p7_items(spark, sf_dir):
    """For each evaluation item the number of documents that contain it."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
