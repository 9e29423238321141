"""Language of documents and of their segments (problem 8), word first with back-off to character n-grams.

A word that the samples know scores its log frequency per language. For another word the longest n-grams that the
samples know decide, from five characters down to one. The model is fitted on the checked samples (at most SAMPLE_ROWS
rows, lowest hash first; the table is fixed at 280) and on at most SAMPLE_DOCS labelled documents, in the forms that
texts appear in: as written, without accents, and for Cyrillic in Latin letters. Documents are scored where they lie, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import VISIBLE
from lodestone.sources.tables import read_table

LANGS = ("en", "ru", "uk", "de", "es", "fr", "pl")
SAMPLE_ROWS = 5000
SAMPLE_DOCS = 1500
LONGEST = 5
MIN_WORDS = 4  # words of a whole sentence
MIN_OTHER = 6  # words of such sentences before a language counts as one of the text
MIN_MARGIN = 1.0  # nats a word by which a sentence of another language must win
MEMO = 300_000  # unknown words that a task remembers

# Names and codes of the languages, in lower case.
LABELS = {
    "en": "en eng english englisch anglais inglés английский англійська angielski",
    "ru": "ru rus russian русский російська russisch russe ruso rosyjski",
    "uk": "uk ukr ukrainian українська украинский ukrainisch ukrainien ucraniano ukraiński",
    "de": "de ger deu german deutsch немецкий німецька allemand alemán niemiecki",
    "es": "es spa spanish español castellano испанский іспанська spanisch espagnol hiszpański",
    "fr": "fr fra fre french français французский французька französisch francés francuski",
    "pl": "pl pol polish polski польский польська polnisch polonais polaco",
}
NO_LANGUAGE = "und unknown xx mul zxx mis none null n/a na undefined ? -"

# Latin letters for Cyrillic, by language where they differ.
CYRILLIC = "а a б b в v г g д d е e ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ  ы y ь  э e ю yu я ya і i ї yi є ye ґ g ё e".split(" ")
UKRAINIAN = {"г": "h", "и": "y", "й": "y", "щ": "shch", "х": "kh", "ь": "", "є": "ye", "ї": "yi", "'": ""}

FENCE = re.compile(r"```.*?(?:```|$)", re.S)
MASK = re.compile(r"`[^`]*`|https?://\S+|www\.\S+|\S+@\S+\.\S+|<[^<>]{1,80}>|\{[^{}]*\}|^\s*\|.*\|\s*$|^\s*(?:user|assistant|system|human|ai|bot|q|a|speaker \d+)\s*:|(?<![\w_/\\])[\w.]+[_/\\][\w_/\\.]+|\b\w+\.(?:md|py|txt|json|lock|log|yml|yaml|sql|sh)\b", re.I)
MASK_SIGNS = re.compile(r"[`/_:|@{<\\]|\.\w")
ASIDE = re.compile(r"[(\[][^()\[\]]{0,80}[)\]]")
CODE_LINE = re.compile(r"\s*(?:(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b|(?:def|class|import|return|curl|git|pip|docker|npm|sudo)\s|from \w+ import|for \w+ in |if __|\$ |>>>|[\d\-:.,TZ ]*\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b)")
CODE_LINES = re.compile(rf"^{CODE_LINE.pattern}", re.M)
CODE_SIGNS = re.compile(r"[=;{}]|->")
ENDS = (".", "!", "?", "…")
LEAD = re.compile(r"\s*(?:(?://|#+|\*|>|--)\s+)?")
MIXED = re.compile(r"[a-z][а-яіїєґ]|[а-яіїєґ][a-z]")
# Letters that look alike in the two scripts.
ALIKE = str.maketrans("aceopxyikmhtbn", "асеорхуікмнтвп")
ALIKE_BACK = str.maketrans("асеорхуі", "aceopxyi")
SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”’»)\]*_]*\s+|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")


def _fold_table() -> dict[int, str | None]:
    t: dict[int, str | None] = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0x2060: None, 0x301: None, 0x2019: "'", 0x2BC: "'"}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c):
            t[c] = base
    return t | {ord("ß"): "ss", ord("ł"): "l", ord("Ł"): "L", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("đ"): "d", ord("ё"): "е", ord("Ё"): "Е"}


_TABLE = _fold_table()
RESIZED = [(chr(c), x or "") for c, x in _TABLE.items() if len(x or "") != 1]  # letters that become none or two
PLAIN = np.arange(0x110000, dtype=np.uint32)
PLAIN[[c for c, x in _TABLE.items() if len(x or "") == 1]] = [ord(x) for x in _TABLE.values() if len(x or "") == 1]


def fold(text: str) -> str:
    """Lower case, without accents on Latin letters and without invisible characters."""
    if text.isascii():
        return text.lower()
    for c, x in RESIZED:
        if c in text:
            text = text.replace(c, x)
    return PLAIN[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().decode("utf-32-le", "surrogatepass").lower()


def latin(text: str, lang: str) -> str:
    table = dict(zip(CYRILLIC[::2], CYRILLIC[1::2], strict=True)) | (UKRAINIAN if lang == "uk" else {})
    return "".join(table.get(c, c) for c in text)


def counted(rows: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """How often each word occurs in texts of each language, Cyrillic ones also in Latin letters."""
    out: Counter = Counter()
    for lang, text in rows:
        if lang in LANGS and text:
            t = fold(unicodedata.normalize("NFC", text))
            out.update((lang, w) for w in WORD.findall(t))
            if lang in ("ru", "uk"):
                out.update((lang, w) for w in WORD.findall(latin(t, lang)))
    return out


class Model:
    """Per-language log frequencies of words and n-grams, from counts of words."""

    def __init__(self, counts_of: dict[tuple[str, str], int]):
        words = [Counter() for _ in LANGS]
        for (lang, w), n in counts_of.items():
            words[LANGS.index(lang)][w] += n
        vocab = sorted(set().union(*words))
        self.ids = {w: i for i, w in enumerate(vocab)}
        total = np.array([max(sum(c.values()), 1) for c in words], float)
        counts = np.array([[c[w] for c in words] for w in vocab], float).reshape(len(vocab), len(LANGS))
        self.words = np.log((counts + 0.02) / (total + 0.02 * len(vocab))).astype(np.float32)
        self.grams: dict[str, np.ndarray] = {}
        raw: dict[str, np.ndarray] = {}
        for k, c in enumerate(words):
            for w, n in c.items():
                for g in self._grams_of(w):
                    raw.setdefault(g, np.zeros(len(LANGS)))[k] += min(n, 3)
        size = {n: np.array([max(sum(v[k] for g, v in raw.items() if len(g) == n), 1) for k in range(len(LANGS))]) for n in range(1, LONGEST + 1)}
        kinds = {n: max(sum(len(g) == n for g in raw), 1) for n in range(1, LONGEST + 1)}
        for g, v in raw.items():
            n = len(g)
            self.grams[g] = np.log((v + 0.1) / (size[n] + 0.1 * kinds[n])).astype(np.float32)

    @staticmethod
    def _grams_of(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]

    def unknown(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams; each place backs off on its own. Zero where nothing is known."""
        w, total, n_used, i = f"^{word}$", np.zeros(len(LANGS), np.float32), 0, 0
        while i < len(w):
            for n in range(min(LONGEST, len(w) - i), 0, -1):
                v = self.grams.get(w[i : i + n])
                if v is not None:
                    total += v - v.mean()
                    n_used += 1
                    break
            i += 1
        return total / n_used * 1.5 if n_used else total


class Scorer:
    """Scores lists of words; remembers the unknown ones."""

    def __init__(self, model: Model):
        self.model, self.known = model, len(model.ids)
        self.reset()

    def reset(self) -> None:
        self.ids = dict(self.model.ids)
        centred = self.model.words - self.model.words.mean(axis=1, keepdims=True)
        self.table = np.vstack([centred, np.zeros((1024, len(LANGS)), np.float32)]) if self.known else np.zeros((1024, len(LANGS)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of each word; every distinct one is looked up once."""
        at, distinct = pd.factorize(np.array(words, dtype=object))
        ids, out = self.ids, []
        for w in distinct:
            i = ids.get(w)
            if i is None:
                i = ids[w] = len(ids)
                if i >= len(self.table):
                    self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.table[i] = self.model.unknown(w)
            out.append(i)
        return self.table[np.array(out, np.int64)[at]]


def _one_script(m: re.Match) -> str:
    w = m.group()
    n = sum("а" <= c <= "ґ" for c in w)
    return w if n in (0, len(w)) else w.translate(ALIKE if 2 * n >= len(w) else ALIKE_BACK)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; code, links, tables, asides in brackets and speaker marks are left out.

    A line break ends a sentence unless the line before has no end mark and the next begins with a small letter.
    """
    if "```" in text:
        text = FENCE.sub("\n", text)
    signs, asides, code, equal = MASK_SIGNS.search(text), "(" in text or "[" in text, CODE_LINES.search(text), CODE_SIGNS.search(text)
    lines: list[str] = []
    open_end = False  # the line before has no end mark
    for line in text.split("\n"):
        if signs and MASK_SIGNS.search(line):
            line = MASK.sub(" ", line)
        if asides and ("(" in line or "[" in line):
            line = ASIDE.sub(" ", line)
        if code and CODE_LINE.match(line) or equal and line.rstrip()[-1:] not in ENDS and CODE_SIGNS.search(line):
            line = ""
        body = LEAD.sub("", line, count=1)
        if open_end and body[:1].islower():
            lines[-1] += " " + body
        else:
            lines.append(body)
        end = lines[-1].rstrip()[-1:]
        open_end = lines[-1] != "" and end not in ENDS and end != ":"
    low = fold("\n".join(lines))
    if not low.isascii() and MIXED.search(low):
        low = WORD.sub(_one_script, low)
    return [w for w in map(WORD.findall, SENTENCE.split(low)) if w]


GROUP_WORDS = 200_000  # words of the texts that are scored together; a longer text is one group


def judged(texts: list[str | None], scorer: Scorer) -> Iterator[tuple[list[tuple[str, float, int]], list[tuple[str, float, str]]]]:
    """Per text: languages with confidence and words, main one first; and runs of sentences with language and confidence."""
    group: list[list[list[str]]] = []
    n = 0
    for text in texts:
        group.append(sentences(text) if text else [])
        n += sum(map(len, group[-1]))
        if n >= GROUP_WORDS:
            yield from _judged_group(group, scorer)
            group, n = [], 0
    yield from _judged_group(group, scorer)


def _judged_group(group: list[list[list[str]]], scorer: Scorer):
    if len(scorer.ids) > scorer.known + MEMO:
        scorer.reset()
    sizes_all = np.array([len(w) for sents in group for w in sents], np.int64)
    if len(sizes_all):
        starts = np.concatenate([[0], np.cumsum(sizes_all)[:-1]])
        score_all = np.add.reduceat(scorer.rows([w for sents in group for ws in sents for w in ws]), starts, axis=0)
        order = np.partition(score_all, len(LANGS) - 2, axis=1)
        best_all = score_all.argmax(axis=1)
        whole_all = (sizes_all >= MIN_WORDS) & ((order[:, -1] - order[:, -2]) / sizes_all > MIN_MARGIN)
    z = 0
    for sents in group:
        if not sents:
            yield [], []
            continue
        a, z = z, z + len(sents)
        score, sizes, best, whole = score_all[a:z], sizes_all[a:z], best_all[a:z], whole_all[a:z]
        weight = np.bincount(best[whole], weights=sizes[whole], minlength=len(LANGS))
        clear = weight.any()
        main = int(weight.argmax()) if clear else int(score.sum(axis=0).argmax())
        others = [int(k) for k in np.argsort(-weight) if k != main and weight[k] >= MIN_OTHER]
        if not others:
            # a sentence that is no clear case, or of a language with too few words, goes with the main language
            words = int(sizes.sum())
            one = (LANGS[main], _confidence(score.sum(axis=0), main, words), words)
            yield [one], [(*one, len(sents))]
            continue
        lang = np.where(whole & (weight >= MIN_OTHER)[best], best, main)
        own = lang == main
        out = [(LANGS[main], _confidence(score[own].sum(axis=0), main, sizes[own].sum() or sizes.sum()), int(sizes[own].sum()))]
        out += [(LANGS[k], _confidence(score[lang == k].sum(axis=0), k, sizes[lang == k].sum()), int(weight[k])) for k in others]
        cut = np.flatnonzero(np.diff(lang)) + 1
        runs = [(LANGS[lang[r[0]]], _confidence(score[r].sum(axis=0), int(lang[r[0]]), sizes[r].sum()), int(sizes[r].sum()), len(r)) for r in np.split(np.arange(len(lang)), cut)]
        yield out, runs


def _confidence(score: np.ndarray, k: int, words: int) -> float:
    """Posterior of language k for a text of that score, tempered so that it does not only reflect the length."""
    z = (score - score.max()) / max(words, 1) ** 0.5
    p = np.exp(z)
    return round(float(p[k] / p.sum()), 4)


def _known(samples: DataFrame, sample_rows: int) -> dict[tuple[str, str], int]:
    rows = samples.select(F.lower(F.trim("lang")).alias("lang"), "text").where("lang is not null and text is not null").orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(sample_rows).collect()
    return counted([(r.lang, r.text) for r in rows])


def fit(samples: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from checked samples: at most sample_rows rows, lowest hash first."""
    return Model(_known(samples, sample_rows))


def fit_on_documents(samples: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from the checked samples and from whole documents whose label agrees with what the samples' model says.

    At most sample_docs labelled documents are read, lowest hash of doc_id first; the two views, label and text, must
    name the same single language, so that wrong labels do not teach. They are scored and their words counted in tasks;
    only the counts come to the driver.
    """
    known = _known(samples, sample_rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for d in batches:
            kept = [(lab, t) for lab, t, (langs, _) in zip(d["label"], d["text"], judged(d["text"].tolist(), scorer), strict=True) if len(langs) == 1 and langs[0][0] == lab]
            found = counted([(lab, " . ".join(" ".join(s) for s in sentences(t))) for lab, t in kept])
            yield pd.DataFrame([(lab, w, n) for (lab, w), n in found.items()], columns=["lang", "word", "n"])

    picked = docs.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where(F.col("label").isin(*LANGS) & F.col("text").rlike(VISIBLE))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).repartition(spark.sparkContext.defaultParallelism, "doc_id")
    taught = picked.mapInPandas(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    for r in taught:
        known[r.lang, r.word] = known.get((r.lang, r.word), 0) + r.n
    return Model(known)


def label_language(c):
    """The language a label names: one of the seven, 'other', or null if it names none."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    base = F.regexp_extract(t, r"^(\p{L}{2,3})(?:[-_].*)?$", 1)
    out = F.when(t.isNull() | (t == "") | t.isin(*NO_LANGUAGE.split()), F.lit(None).cast("string"))
    for lang, names in LABELS.items():
        out = out.when(t.isin(*names.split()) | base.isin(*names.split()), lang)
    return out.otherwise("other")


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, label, main, confidence, langs (lang, confidence, words), segments (lang, confidence, words, sentences).

    Whole texts are read. Null, blank and wordless texts have null main and empty arrays. Repeated rows give repeated
    results; an empty table gives none; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for d in batches:
            got = list(judged(d["text"].tolist(), scorer))
            langs = [[dict(lang=a, confidence=c, words=n) for a, c, n in ls] for ls, _ in got]
            runs = [[dict(lang=a, confidence=c, words=n, sentences=k) for a, c, n, k in rs] if len({r[0] for r in rs}) > 1 else [] for _, rs in got]
            yield pd.DataFrame({"doc_id": d["doc_id"], "label": d["label"], "main": [x[0]["lang"] if x else None for x in langs], "confidence": [x[0]["confidence"] if x else None for x in langs], "langs": langs, "segments": runs})

    x = docs.select("doc_id", label_language(F.col("lang")).alias("label"), F.when(F.col("text").rlike(VISIBLE), F.col("text")).alias("text"))
    return x.mapInPandas(run, "doc_id bigint, label string, main string, confidence double, langs array<struct<lang:string,confidence:double,words:int>>, segments array<struct<lang:string,confidence:double,words:int,sentences:int>>")


def p8_found(spark, sf_dir):
    """Documents with a missing or wrong label, and mixed ones: a row for each language they are written in."""
    x = languages(read_table(spark, sf_dir, "documents"), fit_on_documents(read_table(spark, sf_dir, "lang_samples"), read_table(spark, sf_dir, "documents")))
    case = F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1)
    return x.where("main is not null").where(case).select("doc_id", F.explode("langs").alias("x")).select("doc_id", F.col("x.lang").alias("lang")).distinct()


def p8_languages(spark, sf_dir):
    """Language and confidence of every document."""
    x = languages(read_table(spark, sf_dir, "documents"), fit_on_documents(read_table(spark, sf_dir, "lang_samples"), read_table(spark, sf_dir, "documents")))
    return x.select("doc_id", "label", "main", "confidence", F.size("langs").alias("n_langs"))


def p8_segments(spark, sf_dir):
    """Language and confidence of every segment of the mixed documents."""
    x = languages(read_table(spark, sf_dir, "documents"), fit_on_documents(read_table(spark, sf_dir, "lang_samples"), read_table(spark, sf_dir, "documents")))
    return x.select("doc_id", F.posexplode("segments").alias("segment", "x")).select("doc_id", "segment", "x.*")


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages, "p8_segments": p8_segments}
