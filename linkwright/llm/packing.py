"""Items of varying size in containers of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.storage import stored

#: Items that one task packs at a time.
SHARD_ITEMS = 20_000
#: Containers less full than this after the first round are emptied and their items packed again with those of other shards.
REPACK = 0.97
#: Text is handed to the tokenizer in stretches of about so many characters, cut before a space.
STRETCH = 20_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str) -> int:
    """Tokens of a whole text."""
    return len(_encoding(vocabulary).encode_ordinary(text))


def sized(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, loss): tokens of the whole text, and of them those after its first sentence.

    The first sentence (up to the first . ! ? or line break) is taken as the
    instruction, the rest as the answer that bears loss; a text of one sentence
    bears loss throughout. Null texts have no tokens.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = [token_count(t, path) if t else 0 for t in b["text"]]
            prompt = [token_count(p, path) if p else 0 for p in b["prompt"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": tokens, "loss": [max(n - p, 0) if n > p else n for n, p in zip(tokens, prompt)]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.regexp_extract(F.col(text), r"\A[^.!?\n]*[.!?\n]", 0).alias("prompt"))
    return rows.mapInPandas(run, "doc_id long, tokens long, loss long")


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """Container number of each item; none may exceed capacity tokens, segments items or loss_capacity loss-bearing tokens.

    Containers are filled one after the other: of the items that still fit, the
    one with the largest dot product of its demands and what the container has
    left, each as a share of its limit and weighted by the mean demand of what
    is to be packed, goes in next. Equal items are one type; ties go to the
    type with more tokens.
    """
    kinds, kind, left = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True, return_counts=True)
    limits = np.array([capacity, segments, loss_capacity], dtype="float64")
    demand = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], axis=1) / limits
    weight = (demand * left[:, None]).sum(axis=0) / max(left.sum(), 1)
    members = np.argsort(kind.ravel(), kind="stable")
    begin = np.concatenate([[0], np.cumsum(left)])
    used = np.zeros(len(kinds), dtype="int64")
    out, bin_ = np.empty(len(tokens), dtype="int64"), 0
    alive = np.arange(len(kinds))[::-1]  # more tokens first
    room = np.ones(3)
    fit = alive
    while len(alive):
        fit = fit[(demand[fit] <= room + 1e-12).all(axis=1)]
        if not len(fit):
            if (room == 1).all():
                raise ValueError("an item exceeds a limit")
            bin_ += 1
            room, fit = np.ones(3), alive
            continue
        best = fit[np.argmax(demand[fit] @ (weight * room))]
        out[members[begin[best] + used[best]]] = bin_
        used[best] += 1
        room = room - demand[best]
        if used[best] == left[best]:
            alive, fit = alive[alive != best], fit[fit != best]
    return out


def containers(items: DataFrame, capacity: int = 2048, segments: int = 64, loss_capacity: int | None = None, shard_items: int = SHARD_ITEMS, repack: float = REPACK) -> DataFrame:
    """(doc_id, piece, tokens, loss, container) for items (doc_id, tokens, loss).

    An item goes whole into one container, unless it has more than capacity
    tokens (or more than loss_capacity of loss; the default is capacity): then
    it is split into equal pieces, the fewest that fit. Items without tokens
    take a segment like any other. Null ids are left out; repeated ids are
    items of their own. Shards of about shard_items items are drawn by hash and
    packed each in one task; containers under repack of the capacity are then
    emptied and their items packed once more in larger company, so every item
    is packed and the waste doesn't grow with the number of shards. Container
    numbers are unique, not consecutive.
    """
    loss_capacity = loss_capacity or capacity
    parts = F.greatest(F.ceil(F.col("tokens") / capacity), F.ceil(F.col("loss") / loss_capacity), F.lit(1)).cast("long")
    share = lambda c: F.floor((F.col("piece") + 1) * F.col(c) / F.col("parts")) - F.floor(F.col("piece") * F.col(c) / F.col("parts"))
    whole = items.filter("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("loss", F.lit(0)).alias("loss"))
    pieces = whole.withColumn("parts", parts).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("doc_id", F.col("piece").cast("int").alias("piece"), share("tokens").cast("long").alias("tokens"), share("loss").cast("long").alias("loss"))
    schema = "doc_id long, piece int, tokens long, loss long, container long, fill double"

    def one_round(rows: DataFrame, offset: int, many: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            shard = 0

            def packed() -> pd.DataFrame:
                part = pd.concat(held, ignore_index=True)
                number = pack(part["tokens"].to_numpy(), part["loss"].to_numpy(), capacity, segments, loss_capacity)
                fill = part.groupby(number)["tokens"].transform("sum") / capacity
                base = offset + (int(part["part"].iloc[0]) << 40) + (shard << 24)
                return part.drop(columns="part").assign(container=base + number, fill=fill)

            for b in batches:
                if len(b):
                    held.append(b)
                if sum(map(len, held)) >= 2 * shard_items:  # hashing may overfill a shard; never hold more
                    yield packed()
                    held, shard = [], shard + 1
            if held:
                yield packed()

        return rows.repartition(many, F.xxhash64("doc_id", "piece")).withColumn("part", F.spark_partition_id()).mapInPandas(run, schema)

    pieces = stored(pieces, "pieces")
    n = pieces.count()
    first = stored(one_round(pieces, 0, max(1, -(-n // shard_items))), "packed")
    loose = first.filter(F.col("fill") < repack).select("doc_id", "piece", "tokens", "loss")
    again = one_round(loose, 1 << 62, max(1, -(-loose.count() // shard_items)))
    return first.filter(F.col("fill") >= repack).unionByName(again).drop("fill")
