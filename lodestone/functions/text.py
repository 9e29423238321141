"""Column functions on text: tokens, lexical scores, snippets, cleaning, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD2 = r"[\p{L}\p{N}]{2,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(c) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^\s+", ""), r"\s+$", "")


def all_tokens(c) -> Column:
    """Lower-case words of two or more letters or digits, repeats kept; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(WORD2), F.lit(0))


def query_tokens(c, max_terms: int = 12) -> Column:
    """The first distinct tokens."""
    return F.slice(F.array_distinct(all_tokens(c)), 1, max_terms)


def token_set(c) -> Column:
    """Distinct tokens among the first 120 of the first 800 characters, as near-copy checks compare hits."""
    return F.array_distinct(F.slice(all_tokens(F.substring(_c(c), 1, 800)), 1, 120))


def jaccard(a, b) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def lexical_score(text, phrase: str, tokens: list[str]) -> Column:
    """R2: phrase +3; each token found +1, and +0.15 within the first 33 characters; share of tokens found times 0.25."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    score = F.when(F.lit(bool(phrase)) & t.contains(phrase.lower()), 3.0).otherwise(0.0)
    hits = F.lit(0)
    for k in tokens:
        at = F.instr(t, k)
        hits = hits + (at > 0).cast("int")
        score = score + F.when(at > 0, 1.0).otherwise(0.0) + F.when(at.between(1, 33), 0.15).otherwise(0.0)
    return score + hits * (0.25 / max(len(tokens), 1))


def fields_score(columns, phrase: str, tokens: list[str]) -> Column:
    """Fields joined by line breaks, nulls as empty."""
    return lexical_score(F.concat_ws("\n", *[F.coalesce(_c(c), F.lit("")) for c in columns]), phrase, tokens)


def like_tokens(columns, tokens: list[str], every: bool) -> Column:
    """Any (or every) token as a substring of any column, in either case."""
    one = [F.coalesce(F.greatest(*[F.coalesce(F.lower(_c(c)).contains(k), F.lit(False)) for c in columns]) if len(columns) > 1 else F.lower(_c(columns[0])).contains(k), F.lit(False)) for k in tokens]
    out = one[0]
    for x in one[1:]:
        out = out & x if every else out | x
    return out


def sanitized(c) -> Column:
    """Everything that is no word character becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^\p{L}\p{N}_]+", " "))


def rewritten_query(c) -> Column:
    """Up to 12 distinct tokens, longest first; null unless there are three, and six characters of another text."""
    t = F.array_distinct(all_tokens(c))
    ranked = F.array_sort(F.transform(t, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    out = F.array_join(F.transform(F.slice(ranked, 1, 12), lambda s: s["x"]), " ")
    return F.when((F.size(t) >= 3) & (F.length(out) >= 6) & (out != F.lower(_c(c))), out)


def match_at(c, tokens: list[str]) -> Column:
    """Least place (from 0) of a token, or 0."""
    places = [F.nullif(F.instr(F.lower(_c(c)), F.lit(k)), F.lit(0)) for k in tokens]
    return F.coalesce((F.least(*places) if len(places) > 1 else places[0]) - 1, F.lit(0))


def clipped(c, at: Column, size: int = 240) -> Column:
    """A window of size characters around a place, moved back at the end of the text."""
    start = F.greatest(F.lit(0), F.least(at - F.lit(size // 2), F.length(_c(c)) - F.lit(size)))
    return F.substring(_c(c), start + 1, F.lit(size))


def kb_snippet(c, phrase: str, tokens: list[str]) -> Column:
    """50 characters before the phrase or first token to 50 after it; else the first 100."""
    low = F.lower(_c(c))
    at = F.instr(low, F.lit(phrase.lower())) if phrase else F.lit(0)
    first = F.instr(low, F.lit(tokens[0])) if tokens else F.lit(0)
    at = F.when(at > 0, at).otherwise(first) - 1
    start = F.greatest(F.lit(0), at - 50)
    return F.when(at >= 0, F.substring(_c(c), start + 1, at - start + F.lit(max(len(phrase), 8) + 50))).otherwise(F.substring(_c(c), 1, 100))


def chunks(c, size: int = 1200, overlap: int = 150) -> Column:
    """Fixed windows with overlap, stripped, empty ones dropped; array of struct(chunk_index, content)."""
    size = max(size, 100)
    overlap = size // 4 if overlap >= size else max(overlap, 0)
    t = F.regexp_replace(F.coalesce(_c(c), F.lit("")), "\r\n?", "\n")
    n = F.length(t)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / (size - overlap))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: trimmed(F.substring(t, i * (size - overlap) + 1, F.lit(size))))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x, i: F.struct(i.alias("chunk_index"), x.alias("content")))


def path_bonus(path, tokens: list[str], bonus: float = 0.15) -> Column:
    """A bonus where the path contains a token of three or more letters."""
    long = [k for k in tokens if len(k) >= 3][:40]
    return F.when(like_tokens([path], long, False), bonus).otherwise(0.0) if long else F.lit(0.0)


def strict_form(c) -> Column:
    """A10: lower case, stripped, white space collapsed."""
    return F.regexp_replace(trimmed(F.lower(F.coalesce(_c(c), F.lit("")))), r"\s+", " ")


def loose_form(c) -> Column:
    """A10: the strict form without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(strict_form(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


# Patterns of secrets and what replaces them (X1), applied in this order.
SECRETS = [
    (r"(?i)(api[_-]?key|token|secret|password|passphrase)\s*[:=]\s*([^\s'\"<>]+)", "$1=<REDACTED>"),
    (r"(?i)(authorization\s*:\s*bearer)\s+([^\s'\"<>]+)", "$1 <REDACTED>"),
    (r"\b(sk-[A-Za-z0-9]{16,})\b", "<REDACTED_TOKEN>"),
    (r"\b(ghp_[A-Za-z0-9]{30,})\b", "<REDACTED_TOKEN>"),
    (r"\b(xox[baprs]-[A-Za-z0-9-]{10,})\b", "<REDACTED_TOKEN>"),
    (r"\b(AKIA[0-9A-Z]{16})\b", "<REDACTED_TOKEN>"),
    (r"(?s)-----BEGIN (?:RSA|EC|OPENSSH|DSA|ED25519) PRIVATE KEY-----.*?-----END .*?-----", "<REDACTED_PRIVATE_KEY>"),
    (r"(?s)-----BEGIN PRIVATE KEY-----.*?-----END PRIVATE KEY-----", "<REDACTED_PRIVATE_KEY>"),
    (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{80,}={0,2}(?![A-Za-z0-9+/=])", "<REDACTED_BLOB>"),
]
# Fixed value: the stricter form that also takes quoted values.
QUOTED_SECRET = (r"(?i)(api[_-]?key|token|secret|password|passphrase)[\"']?\s*[:=]\s*[\"']([^\s'\"<>]+)[\"']", "$1=<REDACTED>")


def redacted(c, quoted: bool = False) -> Column:
    """Secrets replaced; JSON texts are covered as text."""
    out = _c(c)
    for pattern, by in [*([QUOTED_SECRET] if quoted else []), *SECRETS]:
        out = F.regexp_replace(out, pattern, by)
    return out


def first_sentences(c, n: int = 2) -> Column:
    """The first n sentences, joined by a dot and a space; null if there is none."""
    s = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"[.!?]+"), trimmed), lambda x: x != "")
    return F.when(F.size(s) > 0, F.concat(F.array_join(F.slice(s, 1, n), ". "), F.lit(".")))


def markdown_text(c) -> Column:
    """Headings, emphasis, code, links and images taken out of markdown, in this order."""
    t = F.coalesce(_c(c), F.lit(""))
    for pattern, by in [(r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"!\[([^\]]*)\]\([^\)]+\)", "$1"), (r"\n{3,}", "\n\n")]:
        t = F.regexp_replace(t, pattern, by)
    return trimmed(t)


def markdown_title(c) -> Column:
    """The first top heading, or null."""
    return F.nullif(trimmed(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?m)^# +(.+)$", 1)), F.lit(""))


def text_title(c) -> Column:
    """The first line that is not blank, if it has fewer than 100 characters."""
    first = F.get(F.filter(F.split(F.coalesce(_c(c), F.lit("")), "\n"), lambda x: trimmed(x) != ""), 0)
    return F.when(F.length(trimmed(first)) < 100, trimmed(first))


def html_text(c) -> Column:
    """Entities decoded, scripts, styles and tags out, white space collapsed."""
    t = F.coalesce(_c(c), F.lit(""))
    for pattern, by in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"), (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " "), (r"\s{2,}", " ")]:
        t = F.regexp_replace(t, pattern, by)
    return trimmed(t)


def html_title(c) -> Column:
    """The title, or Untitled."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?i)<title>([^<]+)</title>", 1), F.lit("")), F.lit("Untitled"))


def html_links(c) -> Column:
    """Link targets in order."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
