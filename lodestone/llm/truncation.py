"""Texts that have lost their end, and the share of them per source (problem 5).

1. Lengths. Per source and measure (characters, characters before a cut mark, bytes), the histogram of lengths is
   searched for lengths that hold far more texts than their neighbours. At each such candidate limit a right-censored
   log-normal is fitted by maximum likelihood (EM on counts and sums of the histogram), and the censoring posterior is
   the share of the texts at the limit that the fitted density cannot explain.
2. Endings. For a text without an end mark, the last two words are looked up in the corpus's own counts of how often
   those words end a sentence and how often they go on; broken words, open brackets and hanging punctuation speak for a
   cut, closed odd endings (links, emoticons, code) against it. This gives a likelihood ratio of cut against complete.
3. Both are combined: prior odds are the censoring posterior at a limit (for a text with an end mark no more than the
   share of cut texts there that the end marks allow), and elsewhere the source's rate of cuts in
   mid-transfer, which EM estimates from the ratios of that source. A text is a case when its posterior exceeds 0.5.

Only counts are gathered: lengths and ratio bins per source, word pairs over the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpointed, read_table

# Marks that a shortening writer leaves at the end of a text.
CUT_MARK = r"(?:\s*(?:\[(?:truncated|cut|snip|\.\.\.|…)\]|\((?:cut|truncated)\)|…|\.{3,}|�+))+$"
SAID_MARK = r"(?:[\[(](?:truncated|cut|snip)[\])]|�)\s*$"
END_MARK = r"(?:[.!?。！？])[\"'”’“»)\]`*_]*$"
# What prints nothing at the end of a text: controls, separators, zero-width space and byte order mark.
BLANK = "".join(map(chr, (*range(0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# Word, number, end of sentence, other sign.
TOKEN = r"[\p{L}\p{M}'’]+|\d+|[.!?]+|[|]|[,;:()\[\]]"
NO_WORD = tuple(".!?|,;:()[]'’")  # what tokens that are no words begin with

MIN_AT_LIMIT = 5  # texts at one length before it can be a limit
NEAR = 20  # lengths on either side that a candidate is compared with
EXCESS = 5.0  # times the neighbours' mean
RATIO_BINS = 0.25
CLUSTERING = 1.5  # times the mean density of sentence ends that one length may see, as texts are built of like sentences


def _shortened(c):
    """A text without the marks of a cut at its end; only texts that end like one are looked at by pattern."""
    return F.when(F.right(c, F.lit(1)).isin("]", ")", "…", "�") | c.endswith("..."), F.regexp_replace(c, CUT_MARK, "")).otherwise(c)


def _texts(df: DataFrame, table: str, rec: str, source: str, text: str) -> DataFrame:
    c = F.col(text).cast("string")
    return df.select(
        F.lit(table).alias("rec_table"), F.col(rec).cast("string").alias("rec_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.rtrim(c, F.lit(BLANK)).alias("text"), F.length(c).cast("long").alias("chars"), F.octet_length(F.rtrim(c, F.lit("�"))).cast("long").alias("bytes"),
    ).where("text <> '' and rec_id is not null")


def texts_of(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """rec_table, rec_id, source, text (without white space at its end), chars and bytes (with it) of both tables; null
    and blank texts are left out, as they have lost nothing. Repeated rows stay: no text is shuffled to find them."""
    return _texts(sessions, "sessions", "id", "client", "user_prompt").unionByName(_texts(reports, "session_reports", "session_id", "writer", "summary"))


# --- lengths -------------------------------------------------------------------------------------------------------


def _cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def fit_censored(n: float, s1: float, s2: float, m: float, limit: float) -> tuple[float, float]:
    """Log-normal mean and deviation from n lengths (sums s1, s2 of their logs and squares) and m censored at limit."""
    mu, sd = s1 / n, math.sqrt(max(s2 / n - (s1 / n) ** 2, 1e-4))
    c = math.log(limit)
    for _ in range(60):
        z = (c - mu) / sd
        tail = max(1 - _cdf(z), 1e-9)
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * h
        e2 = mu * mu + 2 * mu * sd * h + sd * sd * (1 + z * h)
        mu2 = (s1 + m * e1) / (n + m)
        sd2 = math.sqrt(max((s2 + m * e2) / (n + m) - mu2 * mu2, 1e-4))
        if abs(mu2 - mu) + abs(sd2 - sd) < 1e-6:
            break
        mu, sd = mu2, sd2
    return mu, sd


def _posteriors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        post = []
        for n, s1, s2, m, at, length, mean, var in zip(d["n"], d["s1"], d["s2"], d["m"], d["c"], d["len"], d["mean"], d["var"], strict=True):
            few = n < 10
            if few and at < 0.5 * m:
                # a length that most of the longer texts pass is no limit
                post.append(0.0)
                continue
            if few:
                # too few lengths below the limit to fit: the spread over all sources counts as ten more
                n, s1, s2 = n + 10, s1 + 10 * mean, s2 + 10 * (mean * mean + max(var, 0.25))
            mu, sd = fit_censored(n, s1, s2, m, length)
            expected = (n + m) * (_cdf((math.log(length + 0.5) - mu) / sd) - _cdf((math.log(length - 0.5) - mu) / sd))
            post.append(min(max(0.0, 1 - expected / at), 0.9 if few else 1.0))
        yield pd.DataFrame({"rec_table": d["rec_table"], "source": d["source"], "measure": d["measure"], "len": d["len"], "post": post})


def limits(feat: DataFrame) -> DataFrame:
    """Candidate limits and their censoring posterior: rec_table, source, measure, len, post."""
    sizes = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("len")) for k in ("chars", "body", "bytes")])
    h = feat.select("rec_table", "source", F.explode(sizes).alias("x")).select("rec_table", "source", "x.*").groupBy("rec_table", "source", "measure", "len").agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("rec_table", "source", "measure").orderBy("len")
    below, lg = w.rowsBetween(Window.unboundedPreceding, -1), F.log("len")
    near = F.sum("c").over(w.rangeBetween(-NEAR, NEAR)) - F.col("c")
    h = h.select(
        "*", (near / (2.0 * NEAR)).alias("near"), F.sum("c").over(below).alias("n"), F.sum(F.col("c") * lg).over(below).alias("s1"), F.sum(F.col("c") * lg * lg).over(below).alias("s2"),
        F.sum("c").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("m"),
    )
    pooled = h.where("len > 1").groupBy("rec_table", "measure").agg((F.sum(F.col("c") * lg) / F.sum("c")).alias("mean"), (F.sum(F.col("c") * lg * lg) / F.sum("c")).alias("sq"))
    pooled = pooled.select("rec_table", "measure", "mean", (F.col("sq") - F.col("mean") * F.col("mean")).alias("var"))
    some = h.where((F.col("c") >= MIN_AT_LIMIT) & (F.col("c") > EXCESS * F.col("near") + 3) & (F.col("len") > 1)).fillna(0, ["n", "s1", "s2"]).join(F.broadcast(pooled), ["rec_table", "measure"])
    return some.mapInPandas(_posteriors, "rec_table string, source string, measure string, len long, post double").where("post > 0.5")


# --- endings -------------------------------------------------------------------------------------------------------


def tokens(c):
    """Lower-case tokens, every number as 0."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\d+", "0"), F.lit(TOKEN), F.lit(0))


def word_pairs(texts: DataFrame) -> DataFrame:
    """w2, w1, n, ends: how often two neighbouring words occur before a further token, and before an end of sentence.

    Counted over every row that has end marks or bars of its own, repeated ones as often as they occur, the last word of
    each left out. The mark of a cut ends no sentence and is left out too. Pairs are added up before they are shuffled.
    """
    t = texts.where(F.col("text").rlike(r"[.!?|]")).select(tokens(_shortened(F.col("text"))).alias("t")).where("size(t) > 1")
    n = F.size("t") - 1
    three = t.select(F.concat(F.array(F.lit("")), F.slice("t", F.lit(1), n - 1)).alias("w2"), F.slice("t", F.lit(1), n).alias("w1"), F.slice("t", F.lit(2), n).alias("next"))
    pairs = three.select(F.inline(F.arrays_zip("w2", "w1", "next"))).where(~F.substring("w1", 1, 1).isin(*NO_WORD))
    return pairs.groupBy("w2", "w1").agg(F.count("*").alias("n"), F.sum(F.substring("next", 1, 1).isin(".", "!", "?", "|").cast("long")).alias("ends"))


def features(texts: DataFrame) -> DataFrame:
    """Sizes and the form of the ending: kind is mark, end, open, hang, word or closed; w2 and w1 its last tokens.

    Whole texts are looked at for what they leave open, by pattern only if they hold such a sign at all.
    """
    b = texts.withColumn("body_text", _shortened(F.col("text"))).withColumn("tail", F.right("body_text", F.lit(160)))
    count = lambda p: F.when(F.contains(F.col("body_text"), F.lit("`")), F.size(F.regexp_extract_all("body_text", F.lit(p), F.lit(0)))).otherwise(0)
    # brackets and quotes without their partner, anywhere in the text; code and emoticons hold such marks by themselves
    bare = F.regexp_replace("body_text", r"(?s)```.*?```|`[^`\n]*`|[:;]-?[()]", "")
    for _ in range(3):
        bare = F.regexp_replace(bare, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|«[^«»]*»|„[^„“”]*[“”]", "")
    unclosed = F.when((F.length("body_text") > 160) & ~F.col("tail").rlike(END_MARK) & F.col("body_text").rlike(r"[(\[{«„]") & ~F.col("tail").rlike(r"[:;]-?[(]$"), bare.rlike(r"[(\[{«„]")).otherwise(False)
    line = F.substring_index("body_text", "\n", -1)
    row = F.when(F.contains(F.col("body_text"), F.lit("\n|")), (F.length(line) >= 160) & line.rlike(r"^\|.*[^|\s]\s*$")).otherwise(False)
    opened = (
        F.col("tail").rlike(r"[(\[{«„][^)\]}»“”]*$") & ~F.col("tail").rlike(r"[:;]-?[(]$")
        | F.col("tail").rlike(r"<(?:a|b|i|u|p|em|strong|code|pre|li|td|div|span)>[^<]*$|<[a-z/]{0,10}$")
        | F.col("tail").rlike(r"\n\|[^\n]*[^|\n\s]\s*$")
        | F.col("tail").rlike(r"(?:^|[\s.!?,;:])&(?:#\d*|[a-z]{1,7})$")
        | unclosed
        | row
        | (count("```") % 2 == 1)
        | (count("(?<!`)`(?!`)") % 2 == 1) & F.col("tail").rlike(r"`[^`]*$")
    )
    last = F.substring("tail", -1, 1)
    kind = (
        F.when(F.col("text").rlike(SAID_MARK), "said")
        .when(F.col("text") != F.col("body_text"), "mark")
        .when(opened, "open")
        .when(F.col("tail").rlike(END_MARK), "end")
        .when(last.rlike(r"[,;\-–—/(&+=]"), "hang")
        .when(last.rlike(r"[\p{L}\p{M}\p{N}'’]"), "word")
        .otherwise("closed")
    )
    t = tokens(F.col("tail"))
    return b.select(
        "rec_table", "rec_id", "source", kind.alias("kind"), "chars", "bytes", F.when(F.col("text") != F.col("body_text"), F.length("body_text")).otherwise(F.lit(0)).cast("long").alias("body"),
        (F.size(F.regexp_extract_all("tail", F.lit(r"[.!?]\s"), F.lit(0))) / F.greatest(F.length("tail"), F.lit(1))).alias("marks"), F.element_at(F.concat(F.array(F.lit(""), F.lit("")), t), -2).alias("w2"), F.element_at(F.concat(F.array(F.lit("")), t), -1).alias("w1"),
    ).distinct()


def ratios(feat: DataFrame, pairs: DataFrame) -> DataFrame:
    """lr: likelihood of the ending in a cut text against a complete one.

    A cut falls inside a word four times of five, and between two words with the odds of running text; a complete text
    without end mark ends in words that end sentences elsewhere. A last word that no text contains, but that begins
    one that follows the same word elsewhere, is a broken word.
    """
    base, inside = 0.12, 0.2
    word = pairs.groupBy("w1").agg(F.sum("n").alias("n1"), F.sum("ends").alias("e1"))
    tails = feat.where("kind = 'word'").select("w2", "w1").distinct()
    known = tails.join(pairs, ["w2", "w1"], "left").join(word, "w1", "left")
    # beginnings of the words that follow w2, each once, met by equality: no word meets all followers of a frequent one
    begins = pairs.where("length(w1) > 1").select("w2", F.explode(F.transform(F.sequence(F.lit(1), F.length("w1") - 1), lambda i: F.substring(F.col("w1"), F.lit(1), i))).alias("w1"))
    broken = known.where("n is null").select("w2", "w1").join(begins, ["w2", "w1"], "left_semi").withColumn("broken", F.lit(True))
    n1, e1, n, e = (F.coalesce(F.col(c), F.lit(0)) for c in ("n1", "e1", "n", "ends"))
    p1 = (e1 + 2 * base) / (n1 + 2)
    p = (e + 2 * p1) / (n + 2)
    known = known.join(broken, ["w2", "w1"], "left")
    lr = F.when(F.col("broken"), F.when(n1 == 0, 5000.0).otherwise(200.0)).when(n1 == 0, F.when(F.col("w1") == "0", 1.0).otherwise(6.0)).otherwise(inside * base / p)
    known = known.select("w2", "w1", lr.alias("wlr"))
    return feat.join(known, ["w2", "w1"], "left").withColumn(
        "lr",
        F.when(F.col("kind") == "end", 0.013).when(F.col("kind") == "open", 3000.0).when(F.col("kind") == "hang", 500.0).when(F.col("kind") == "said", 5000.0).when(F.col("kind") == "mark", 8.0).when(F.col("kind") == "closed", 0.02).otherwise(F.col("wlr")),
    )


def _rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        rates = []
        for bins, counts in zip(d["bins"], d["counts"], strict=True):
            r, c = np.exp(np.asarray(bins, float) * RATIO_BINS), np.asarray(counts, float)
            pi = 0.1
            for _ in range(200):
                post = pi * r / (pi * r + 1 - pi)
                pi = min(max(float((post * c).sum() / c.sum()), 1e-4), 0.99)
            rates.append(pi)
        yield pd.DataFrame({"rec_table": d["rec_table"], "source": d["source"], "rate": rates})


def rates(r: DataFrame) -> DataFrame:
    """The share of cuts away from limits per source, by EM over a histogram of the ratios."""
    h = r.groupBy("rec_table", "source", F.round(F.log("lr") / RATIO_BINS).alias("bin")).agg(F.count("*").alias("c"))
    return h.groupBy("rec_table", "source").agg(F.collect_list("bin").alias("bins"), F.collect_list("c").alias("counts")).mapInPandas(_rates, "rec_table string, source string, rate double")


def cut_at_limits(x: DataFrame) -> DataFrame:
    """cut_share: the share of cut texts among those at a source's limits, from how many of them have an end mark; end_lr:
    likelihood of an end mark in a cut text against a complete one there.

    A cut leaves an end mark where it falls right behind one or the white space after it, which is as likely as such
    places are frequent in the last part of the texts at the limit. A complete text has one with the share seen away from the limits. The
    share at the limits is a mixture of both, so complete texts that happen to have the limit's length show in this way.
    Both are null where a source hardly uses end marks.
    """
    end, limit = (F.col("kind") == "end").cast("double"), F.col("censored") > 0
    g = x.groupBy("rec_table", "source").agg(F.avg(F.when(limit, end)).alias("at"), F.avg(F.when(~limit, end)).alias("off"), (2 * CLUSTERING * F.avg(F.when(limit, F.col("marks")))).alias("chance"))
    share, some = (F.col("off") - F.col("at")) / (F.col("off") - F.col("chance")), F.col("off") > 2 * F.col("chance")
    return g.select("rec_table", "source", F.when(some, F.greatest(F.lit(1e-4), F.least(share, F.lit(0.999)))).alias("cut_share"), F.when(some, F.col("chance") / F.col("off")).alias("end_lr"))


def scored(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """rec_table, rec_id, source, posterior for every text that prints something.

    Repeated rows count once. Null sources are one source of their own. A row without id is left out. Empty tables give
    no rows; further columns are ignored; texts of any length are read whole, for the counts and for what they leave open.
    """
    texts = texts_of(sessions, reports)
    # all three feed several sums each; no text is carried on
    feat = checkpointed(features(texts))
    r = checkpointed(ratios(feat, checkpointed(word_pairs(texts))))
    lim = limits(feat).groupBy("rec_table", "source").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("measure") == k, F.struct("len", "post")))).alias(f"at_{k}") for k in ("chars", "body", "bytes")])
    x = r.join(lim, ["rec_table", "source"], "left")
    # a mark may stand after white space that went with the cut, so the part before it may be a little shorter
    places = [("chars", F.col("chars")), ("bytes", F.col("bytes")), *[("body", F.col("body") + i) for i in (0, 1, 2)]]
    at = F.greatest(*[F.coalesce(F.try_element_at(F.col(f"at_{k}"), n), F.lit(0.0)) for k, n in places])
    x = x.select("rec_table", "rec_id", "source", "kind", "lr", "w2", "w1", "chars", "marks", at.alias("censored"))
    x = x.join(rates(x.where("censored = 0")), ["rec_table", "source"], "left")
    x = x.join(cut_at_limits(x), ["rec_table", "source"], "left")
    at_limit = F.least("censored", F.lit(0.999), F.when(F.col("kind") == "end", F.col("cut_share")))
    prior = F.when(F.col("censored") > 0, at_limit).otherwise(F.coalesce("rate", F.lit(0.01)))
    lr = F.coalesce(F.when((F.col("censored") > 0) & (F.col("kind") == "end"), F.col("end_lr")), F.col("lr"))
    odds = prior / (1 - prior) * lr
    return x.withColumn("posterior", odds / (1 + odds))


def p5_found(spark, sf_dir):
    """Rows whose text has lost its end."""
    x = scored(read_table(spark, sf_dir, "sessions"), read_table(spark, sf_dir, "session_reports"))
    return x.where("posterior > 0.5").select("rec_table", "rec_id").distinct()


def p5_sources(spark, sf_dir):
    """Texts, cut texts and their share for each client and writer."""
    x = scored(read_table(spark, sf_dir, "sessions"), read_table(spark, sf_dir, "session_reports"))
    cut = F.sum((F.col("posterior") > 0.5).cast("bigint"))
    return x.groupBy("rec_table", "source").agg(F.count("*").alias("texts"), cut.alias("cut"), F.round(cut / F.count("*"), 4).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_sources": p5_sources}
