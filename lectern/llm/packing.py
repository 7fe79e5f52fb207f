"""Filling fixed-capacity containers with whole items: vector bin packing by the dot-product heuristic.

An item has three sizes (tokens, one segment, loss-bearing tokens) and a container a limit on each. The open
container takes, of the items that fit, the one whose sizes have the greatest dot product with the room left,
each dimension weighted by how much of it all items need. Items of equal sizes are one class, so a choice is
made among classes, and a class is found by its sizes, not by looking at every item.

Items are first dealt into lots of about the same number by a hash of their key, one lot per task: a container
holds items of one lot only. A lot has thousands of containers, so the few that end up partly empty cost little,
and neither a lot nor a container grows with the data.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored

#: Where the vocabulary files of public tokenizers lie, unless said otherwise.
TOKENIZERS = "/opt/tokenizers"


@dataclass(frozen=True)
class PackOptions:
    """lot: items per lot. segments: most items in a container. loss_share: most loss-bearing tokens of a
    container, as a share of its capacity. vocabulary: file of byte-pair ranks below ``tokenizers``."""

    lot: int = 8000
    segments: int = 64
    loss_share: float = 1.0
    tokenizers: str = TOKENIZERS
    vocabulary: str = "byte_bpe_multi_50k.tiktoken"


# Fixed value: how the byte-pair vocabularies cut a text before merging.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("lectern", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _encode(code, text: str) -> list[int]:
    try:
        return code.encode_ordinary(text)
    except UnicodeEncodeError:  # lone surrogates
        return code.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def token_counts(df: DataFrame, key: str, text: str, options: PackOptions, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, tokens): the number of tokens of every text; null counts as empty."""
    path = f"{options.tokenizers}/{options.vocabulary}"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            counts = [len(_encode(code, t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(counts, pa.int64())], [*kept, "tokens"])

    kept = (key, *keep)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", tokens long"
    return df.select(F.col(text).alias("_text"), *kept).mapInArrow(of_batches, schema)


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """The container of each item; every item must fit an empty one.

    Containers are filled one after the other. The choice among fitting classes is by dot product of the
    item's sizes with the room left, both as shares of the limits; ties go to the larger item, then to the
    class first in order, so the result depends on the items alone.
    """
    order = np.lexsort((loss, tokens))
    classes, starts, counts = np.unique(np.stack([tokens[order], loss[order]]), axis=1, return_index=True, return_counts=True)
    t, l = classes[0].astype(float), classes[1].astype(float)
    left = counts.copy()
    need = np.array([tokens.sum() / capacity, len(tokens) / segments, loss.sum() / max(1, loss_limit)])
    weight = need / max(need.max(), 1e-9)
    ct, cs, cl = t / capacity * weight[0], weight[1] / segments, l / max(1, loss_limit) * weight[2]
    container_of_class: list[list[int]] = [[] for _ in range(len(t))]
    todo, container = len(tokens), -1
    alive = np.arange(len(t))
    while todo:
        container += 1
        room_t, room_s, room_l = float(capacity), segments, float(loss_limit)
        while room_s and todo:
            upto = np.searchsorted(t[alive], room_t, "right")  # classes are sorted by tokens
            if not upto:
                break
            these = alive[:upto]
            if room_l < loss_limit or l[these[-1]] > room_l:
                these = these[l[these] <= room_l]
                if not len(these):
                    break
            score = ct[these] * (room_t / capacity) + cs * (room_s / segments) + cl[these] * (room_l / max(1, loss_limit))
            best = these[len(score) - 1 - int(np.argmax(score[::-1]))]
            # as long as nothing else could be better, the same class goes in again
            container_of_class[best].append(container)
            left[best] -= 1
            todo -= 1
            room_t -= t[best]
            room_l -= l[best]
            room_s -= 1
            if not left[best]:
                alive = alive[alive != best]
    out = np.empty(len(tokens), np.int64)
    for k, own in enumerate(container_of_class):
        out[order[starts[k] : starts[k] + counts[k]]] = own
    return out


def pieces_of(items: DataFrame, key: str, capacity: str) -> DataFrame:
    """items with ``piece`` and the piece's first token and tokens: an item above the capacity is split at it."""
    whole = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col(capacity))).cast("int")
    return (
        items.withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
        .withColumn("first_token", F.col("piece") * F.col(capacity).cast("long"))
        .withColumn("piece_tokens", F.least(F.col("tokens") - F.col("first_token"), F.col(capacity).cast("long")))
    )


def fill(items: DataFrame, budgets: DataFrame, key: str, options: PackOptions = PackOptions(), loss: Callable | None = None) -> DataFrame:
    """(budget, key, piece, first_token, tokens, loss_tokens, container) of every item for every budget.

    ``items``: (key, tokens[, loss_tokens]) with unique keys; budgets: (budget_name, capacity_tokens), a fixed
    list. Items of no tokens go along as segments of no length. A budget without a positive capacity gives no
    rows; an item longer than the capacity is split into pieces of the capacity and a rest. container is
    ``lot:number``. Without ``loss_tokens`` every token bears loss.
    """
    borne = F.least(F.coalesce("loss_tokens", "tokens"), F.col("tokens")) if "loss_tokens" in items.columns else F.col("tokens")
    sized = stored(items.where(F.col(key).isNotNull() & F.col("tokens").isNotNull()).select(key, "tokens", borne.cast("long").alias("loss_tokens")))
    lots = max(1, math.ceil(sized.count() / options.lot))
    plans = [(r.budget_name, int(r.capacity_tokens)) for r in budgets.where("capacity_tokens > 0").select("budget_name", "capacity_tokens").distinct().collect()]
    kind = sized.schema[key].dataType.simpleString()
    if not plans:
        return sized.sparkSession.createDataFrame([], f"budget_name string, `{key}` {kind}, piece int, first_token long, tokens long, loss_tokens long, container string")
    dealt = sized.withColumn("lot", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(lots)).cast("int"))

    def fill_lot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        lot = int(pdf["lot"].iloc[0])
        out = []
        tokens, loss_tokens = pdf["tokens"].to_numpy(np.int64), pdf["loss_tokens"].to_numpy(np.int64)
        for name, capacity in sorted(plans):
            n = np.maximum(1, -(-tokens // capacity))
            item = np.repeat(np.arange(len(tokens)), n)
            piece = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            first = piece * capacity
            size = np.minimum(tokens[item] - first, capacity)
            # what an item has of loss-bearing tokens stands at its end
            bearing = np.clip(loss_tokens[item] - (tokens[item] - first - size), 0, size)
            limit = max(1, int(capacity * options.loss_share))
            container = pack(size, np.minimum(bearing, limit), capacity, options.segments, limit)
            out.append(
                pd.DataFrame(
                    {
                        "budget_name": name,
                        key: pdf[key].to_numpy()[item],
                        "piece": piece.astype(np.int32),
                        "first_token": first,
                        "tokens": size,
                        "loss_tokens": bearing,
                        "container": [f"{lot}:{c}" for c in container],
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    schema = f"budget_name string, `{key}` {kind}, piece int, first_token long, tokens long, loss_tokens long, container string"
    return dealt.groupBy("lot").applyInPandas(fill_lot, schema)
