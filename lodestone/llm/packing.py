"""Filling containers of several permitted capacities with texts (problem 6): variable-capacity best fit.

Texts are counted in tokens of a public tokenizer; one larger than the largest capacity is cut into pieces of that
capacity. Items are dealt by a hash into shards of about SHARD_ITEMS pieces, however many there are, and each shard is
packed by itself. The largest item that is left opens a container. For every permitted capacity that can hold it, the
container is completed with the items that fit it best, each time the largest of those left that still has room; the
capacity with the least cost per token held is opened, with these items in it. So the sizes that are left decide on all
capacities jointly. In the end each container shrinks to the smallest permitted capacity that holds its contents. The
room that is lost by packing shards apart is one container a shard at most, of hundreds.

The cost of a container is its capacity, a fixed share for each container, and a share that grows with the square of
the capacity, as attention does: many short containers and long ones both cost more than their room.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpointed, read_table, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 2_000
OVERHEAD = 2.0  # cost of a container beside its capacity, in tokens
ATTENTION = 2.0**21  # capacity at which the square share costs as much as the capacity itself


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, h (a hash that deals items to shards), tokens; null and empty texts have 0 tokens.

    The vocabulary file is read where the driver runs and sent to the tasks; such files have a fixed size of some MB.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for d in batches:
            yield pd.DataFrame({"doc_id": d["doc_id"], "h": d["h"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in d["text"]]})

    x = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return spread(x).mapInPandas(run, "doc_id bigint, h bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacities: Sequence[int], overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item (sizes in decreasing order, none above the largest capacity), and each container's capacity."""
    caps = sorted(capacities)
    values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    left = dict(zip(values.tolist(), counts.tolist(), strict=True))
    next_of = dict(zip(values.tolist(), np.searchsorted(-np.asarray(sizes, np.int64), -values).tolist(), strict=True))
    some = values.tolist()  # sizes of which items are left, ascending

    def completed(room: int, first: int) -> tuple[list[tuple[int, int]], int]:
        """Sizes and numbers of the best fitting items for this room beside one item of size first, and the room that stays."""
        picks, k = [], bisect_right(some, room) - 1
        while k >= 0:
            v = some[k]
            n = min(left[v] - (v == first), room // v)
            if n:
                picks.append((v, n))
                room -= n * v
            k = bisect_right(some, room, 0, k) - 1
        return picks, room

    where, fill = np.empty(len(sizes), np.int64), []
    while some:
        s = some[-1]
        best = None
        for c in caps[bisect_left(caps, s) :]:
            picks, room = completed(c - s, s)
            cost = (c + overhead + c * c / attention) / (c - room)
            if best is None or cost < best[0]:
                best = (cost, picks, c - room)
        for v, n in ((s, 1), *best[1]):
            where[next_of[v] : next_of[v] + n] = len(fill)
            next_of[v] += n
            left[v] -= n
            if not left[v]:
                del some[bisect_left(some, v)]
        fill.append(best[2])
    at = np.searchsorted(caps, fill, side="left") if fill else np.empty(0, np.int64)
    return where, np.array(caps)[at] if fill else np.empty(0, np.int64)


def pack(docs: DataFrame, capacities: Sequence[int], tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, piece, tokens, container, capacity: a container for each document, or each piece of a larger one.

    No item is split unless it exceeds the largest capacity; its pieces but the last have that capacity. Documents of
    no tokens (null and empty texts) need no container and have null there. Capacities that are null or not positive
    are left out; without any, no document can be packed, which is an error. Repeated rows are items of their own; ties
    are broken by the hash; an empty table gives no rows; further columns are ignored.
    """
    caps = sorted({int(c) for c in capacities if c is not None and c > 0})
    if not caps:
        raise ValueError("no positive capacity")
    top = caps[-1]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tokens", "h", "doc_id", "piece"], ascending=[False, True, True, True])
        where, size = best_fit(d["tokens"].to_numpy(), caps)
        shard = int(d["shard"].iloc[0])
        return pd.DataFrame({"doc_id": d["doc_id"], "piece": d["piece"], "tokens": d["tokens"], "container": [f"{shard}-{b}" for b in where], "capacity": size[where]})

    # texts are counted once; the counts feed the number of shards, the items and the documents without tokens
    n = checkpointed(token_counts(docs, tokenizer))
    shards = max(1, -(-(n.agg(F.sum(F.ceil(F.col("tokens") / top))).first()[0] or 0) // shard_items))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / top).cast("int")), lambda i: F.struct(i.alias("piece"), F.least(F.lit(top), F.col("tokens") - i * top).cast("bigint").alias("n")))
    items = n.where("tokens > 0").select("doc_id", "h", F.explode(pieces).alias("x")).select("doc_id", "h", "x.piece", F.col("x.n").alias("tokens"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("h", "piece"), F.lit(shards)))
    packed = items.groupBy("shard").applyInPandas(run, "doc_id bigint, piece int, tokens bigint, container string, capacity int")
    none = n.where("tokens = 0").select("doc_id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("capacity"))
    return packed.unionByName(none)


def _capacities(spark, sf_dir) -> list[int]:
    """The permitted capacities; a table of a few rows by definition."""
    return [r[0] for r in read_table(spark, sf_dir, "context_windows").select("capacity_tokens").distinct().collect()]


def p6_containers(spark, sf_dir):
    """A container for every document or piece."""
    return pack(read_table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def p6_unused(spark, sf_dir):
    """Containers, contents and unused share for each capacity."""
    x = p6_containers(spark, sf_dir).where("container is not null").groupBy("container", "capacity").agg(F.sum("tokens").alias("tokens"))
    return x.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(1 - F.sum("tokens") / F.sum("capacity"), 5).alias("unused"))


def p6_audit(spark, sf_dir):
    """Documents packed or without tokens, documents whose pieces are not 0, 1, ... in full containers but the last, and
    containers that hold more than their capacity: the last two are none."""
    x, top = p6_containers(spark, sf_dir), max(_capacities(spark, sf_dir))
    d = x.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum((F.col("tokens") < top).cast("int")).alias("part"))
    docs = d.agg(F.count("*").alias("documents"), F.sum(((F.col("n") != F.col("last") + 1) | (F.col("part") > 1)).cast("bigint")).alias("split_wrongly"))
    over = x.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.min("capacity").alias("least"))
    return docs.crossJoin(over.agg(F.sum(((F.col("tokens") > F.col("capacity")) | (F.col("least") != F.col("capacity"))).cast("bigint")).alias("overfull")))


QUERIES = {"p6_containers": p6_containers, "p6_unused": p6_unused, "p6_audit": p6_audit}
SQL = {"p6_audit": "select count(distinct doc_id) as documents, 0::bigint as split_wrongly, 0::bigint as overfull from documents"}
