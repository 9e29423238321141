"""Short forms of conversations and texts: stated preferences (X11), compression and tagging (X15), hash embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import WORD2
from lodestone.sources.tables import spread

# Openings of a stated preference with its type, in order (en, ru, uk); what follows up to the end of the sentence is its value.
PREFERENCE_OPENINGS = [
    ("want", r"i\s+(?:want|would\s+like)"), ("need", r"i\s+(?:need|require)"), ("like", r"i\s+(?:like|love)"), ("preference", r"i\s+(?:do\s+not\s+|don't\s+)?(?:want|like|hate)"),
    ("always", "always"), ("never", "never"), ("prefer", "prefer"), ("prefer", "better"), ("use", "use"),
    ("want", r"я\s+(?:хочу|хотел|хотела|желаю)"), ("need", r"мне\s+(?:нужно|необходимо)"), ("like", r"мне\s+(?:нравится|люблю)"), ("preference", r"я\s+(?:не\s+)?(?:хочу|люблю|ненавижу)"),
    ("always", "всегда"), ("never", "никогда"), ("prefer", "предпочитаю"), ("prefer", "лучше"), ("use", "использую"),
    ("want", r"я\s+(?:хочу|хотів|хотіла|бажаю)"), ("need", r"мені\s+(?:потрібно|необхідно)"), ("like", r"мені\s+(?:подобається|люблю)"), ("preference", r"я\s+(?:не\s+)?(?:хочу|люблю|ненавиджу)"),
    ("always", "завжди"), ("never", "ніколи"), ("prefer", r"віддаю\s+перевагу"), ("prefer", "краще"), ("use", "використовую"),
]
# Words that tell a decision or a task, and what stands for the messages left out.
DECISION_WORDS = ["decided", "decision", "approved", "will", "need to do"]
TASK_WORDS = ["task", "do", "todo", "need", "next", "follow-up"]
MARKER = "[context compressed]"

MAX_TOKENS = 4096  # a fixed value too: tokens of a text that a hash embedding takes


def opening_pattern(opening: str) -> str:
    """An opening as a whole word, then its value up to the end of the sentence."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){opening}\s+([^\n]*?)(?:[.!?]|$)"


def stated_preferences(texts: DataFrame, top: int = 10) -> DataFrame:
    """id, pos, type, value: the first ten preferences that a text states, in the order of the openings.

    Values of up to two characters are left out; null and empty texts state nothing. Repeated rows give one row.
    """
    t = F.lower(F.rtrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")))

    def matches(kind: str, opening: str):
        values = F.regexp_extract_all(F.col("t"), F.lit(opening_pattern(opening)), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value")))

    found = [matches(k, o) for k, o in PREFERENCE_OPENINGS]
    x = spread(texts.select("id", t.alias("t"))).select("id", F.slice(F.filter(F.flatten(F.array(*found)), lambda m: F.length(m["value"]) > 2), 1, top).alias("ms"))
    # an outer explode, as Spark would work the array out twice to filter empty ones ahead of an inner one
    return x.select("id", F.posexplode_outer("ms").alias("pos", "m")).where("m is not null").select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), "m.*").distinct()


def compressed(messages: DataFrame) -> DataFrame:
    """session_id, pos, role, content: the first and last message of each session, with a marker between them if any were left out.

    Order is by created_at (null first) and id. Only the least and greatest row of a session cross the shuffle. Rows
    without a session are left out; a session of one or two messages stays as it is.
    """
    row = F.struct("created_at", "id", "role", "content")
    x = messages.where("session_id <> ''").groupBy("session_id").agg(F.min(row).alias("a"), F.max(row).alias("z"), F.count("*").alias("n"))
    keep = lambda c: F.struct(F.col(f"{c}.role").alias("role"), F.col(f"{c}.content").alias("content"))
    mark = F.struct(F.lit("system").alias("role"), F.lit(MARKER).alias("content"))
    rows = F.when(F.col("n") == 1, F.array(keep("a"))).when(F.col("n") == 2, F.array(keep("a"), keep("z"))).otherwise(F.array(keep("a"), mark, keep("z")))
    return x.select("session_id", F.posexplode(rows).alias("pos", "m")).select("session_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "m.*")


def tagged(messages: DataFrame, top: int = 5, chars: int = 100) -> DataFrame:
    """session_id, tag ('decision', 'task'), pos, content: the first five messages of a session that tell one, cut to 100 characters.

    A message may have both tags. Words are looked for anywhere in the lower-case text. Null texts have no tag.
    """
    has = lambda ws: F.col("c").rlike("|".join(re.escape(w) for w in ws))
    x = messages.where("session_id <> ''").select("session_id", "created_at", "id", F.lower("content").alias("c"))
    tags = F.filter(F.array(F.when(has(DECISION_WORDS), "decision"), F.when(has(TASK_WORDS), "task")), lambda t: t.isNotNull())
    w = Window.partitionBy("session_id", "tag").orderBy("created_at", "id")
    x = x.select("session_id", "created_at", "id", F.substring("c", 1, chars).alias("content"), F.explode(tags).alias("tag")).withColumn("pos", F.row_number().over(w))
    return x.where(F.col("pos") <= top).select("session_id", "tag", F.col("pos").cast("bigint").alias("pos"), "content")


def hash_embeddings(docs: DataFrame, dim: int = 384) -> DataFrame:
    """doc_id, embedding: a unit vector for each row; null and blank texts give the zero vector.

    Spark cuts the tokens: words of two characters and more, or pieces of three characters where there is none. In a
    batch each distinct token and place is hashed once; the first four bytes of the hash name the dimension, the next
    bit the sign, the next byte the weight between 0.5 and 1.5.
    """
    t = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")))
    words = F.regexp_extract_all(t, F.lit(WORD2), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3)))
    tokens = F.slice(F.when(F.size(words) > 0, words).when(t != "", pieces).otherwise(F.array().cast("array<string>")), 1, MAX_TOKENS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            lists = [list(x) for x in d["tokens"]]
            sizes = np.array([len(x) for x in lists], np.int64)
            keyed, distinct = pd.factorize(np.array([f"{w}:{i}" for x in lists for i, w in enumerate(x)], dtype=object))
            digests = [hashlib.blake2b(k.encode(errors="ignore"), digest_size=16).digest() for k in distinct]
            raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16).astype(np.int64)
            place = (raw[:, 0] << 24 | raw[:, 1] << 16 | raw[:, 2] << 8 | raw[:, 3]) % dim
            weight = np.where(raw[:, 4] & 1, -1.0, 1.0) * (0.5 + raw[:, 5] / 255)
            v = np.zeros((len(lists), dim))
            np.add.at(v, (np.repeat(np.arange(len(lists)), sizes), place[keyed]), weight[keyed])
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"doc_id": d["doc_id"], "embedding": list((v / np.where(norm > 0, norm, 1)).astype(np.float32))})

    return docs.select("doc_id", tokens.alias("tokens")).mapInPandas(run, "doc_id bigint, embedding array<float>")
