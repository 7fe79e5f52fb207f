"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training run u in [0, 1]: linear from (1 + tilt) to (1 - tilt) times
its share. The integral of the schedule up to u, times the size of the mix, is the source's cumulative demand in
tokens; the cumulative tokens of its draws, inverted through that integral, give each draw its position, and one
range-sort by position makes the mix. Every stretch of the mix then has each source at its scheduled weight.

Cumulative tokens are sums over blocks of a source (a block is a hash range of its rows, made so that it fits a
task), then within the blocks, so a source that holds a third of all rows is never one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import stored


@dataclass(frozen=True)
class MixOptions:
    """rows: rows per block of a source. tilt: how much more than its share the sources of the smallest shares
    come late and those of the greatest come early, -1..1 at the ends of the order."""

    rows: int = 20000
    tilt: float = 0.5


def source_name(column: Column) -> Column:
    """A source as targets write it: lower case, no blanks around, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | None = None) -> list[dict]:
    """Tokens each source gives to a mix of ``size`` tokens (all tokens of targeted sources if not said).

    A source gives at most its tokens times its repeats. What a capped source can't give is shared among the
    others by their targets, again and again until none is capped any more; if all are, the mix is smaller.
    """
    shares: dict[str, list] = {}
    for name, share, repeats in targets:
        if name is not None and share is not None and share > 0:
            entry = shares.setdefault(name, [0.0, 0])
            entry[0] += share
            entry[1] = max(entry[1], repeats if repeats is not None else 1)
    whole = sum(s for s, _ in shares.values())
    if not whole:
        return []
    room = {n: totals.get(n, 0) * max(0, r) for n, (_, r) in shares.items()}
    size = sum(totals.get(n, 0) for n in shares) if size is None else size
    given: dict[str, float] = {}
    open_, rest = dict(shares), float(size)
    while open_ and rest > 0:
        weight = sum(s for s, _ in open_.values())
        capped = [n for n, (s, _) in open_.items() if rest * s / weight >= room[n]]
        if not capped:
            given |= {n: rest * s / weight for n, (s, _) in open_.items()}
            break
        for n in capped:
            given[n] = float(room[n])
        rest -= sum(room[n] for n in capped)
        open_ = {n: v for n, v in open_.items() if n not in given}
    return [
        {"source": n, "target": s / whole, "repeats": max(0, r), "tokens": totals.get(n, 0), "demand": int(math.floor(given.get(n, 0.0)))}
        for n, (s, r) in sorted(shares.items())
    ]


def _tilts(plans: list[dict], tilt: float) -> dict[str, float]:
    """Tilts of the schedules whose share-weighted sum is 0, so that the weights sum to one at any time."""
    total = sum(p["demand"] for p in plans) or 1
    order = sorted((p for p in plans if p["demand"]), key=lambda p: (-p["demand"], p["source"]))
    if len(order) < 2:
        return {p["source"]: 0.0 for p in plans}
    raw = {p["source"]: 1 - 2 * k / (len(order) - 1) for k, p in enumerate(order)}
    mean = sum(raw[p["source"]] * p["demand"] / total for p in order)
    centred = {n: r - mean for n, r in raw.items()}
    most = max(abs(c) for c in centred.values()) or 1
    return {p["source"]: tilt * centred.get(p["source"], 0.0) / most for p in plans}


def draw(items: DataFrame, key: str, targets: DataFrame, options: MixOptions = MixOptions(), size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Draws and shares of a mix.

    ``items``: (key, source, tokens), keys unique; ``targets``: (source, target_share, max_repeats), a fixed
    list. Draws are (source, key, repeat, tokens, position): whole documents in the order of their hash, the
    whole source before any repeat, until the source's demand is met; the last draw may exceed it, unless that
    would exceed the repeats. Position is 0..1; the mix is in its order (draws are returned range-sorted by it).
    Shares are (source, target_share, reached_share, tokens, drawn_tokens, draws, repeats, met); met tells
    whether the target was reached within one percent of itself. Rows without a key, source or token, and
    sources without target, are not drawn. An empty side gives empty draws.
    """
    rows = items.where(F.col(key).isNotNull() & (F.col("tokens") > 0)).select(key, source_name(F.col("source")).alias("source"), F.col("tokens").cast("long").alias("tokens"))
    wanted = [(r[0], r[1], r[2]) for r in targets.select(source_name(F.col("source")), "target_share", "max_repeats").collect()]
    spark = items.sparkSession
    named = spark.createDataFrame([(n,) for n in sorted({w[0] for w in wanted if w[0]})], "source string")
    rows = stored(rows.join(F.broadcast(named), "source", "left_semi"))
    counted = {r.source: (r.tokens, r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    plans = plan({n: t for n, (t, _) in counted.items()}, wanted, size)
    tilts = _tilts(plans, options.tilt)
    table = [
        (p["source"], p["target"], p["repeats"], p["tokens"], p["demand"], tilts[p["source"]], max(1, math.ceil(counted.get(p["source"], (0, 0))[1] / options.rows)))
        for p in plans
    ]
    schedule = F.broadcast(spark.createDataFrame(table, "source string, target double, repeats int, of long, demand long, tilt double, blocks long"))
    mixed = rows.join(schedule, "source").withColumn("h", F.xxhash64(key, F.lit(29)))
    # a block is a range of hashes, so blocks follow each other in the order of the hash
    block = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("blocks")).cast("long")
    mixed = mixed.withColumn("block", F.greatest(F.lit(0), F.least(block, F.col("blocks") - 1)))
    sums = mixed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    ahead = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.withColumn("ahead", F.coalesce(ahead, F.lit(0))).select("source", "block", "ahead")
    own = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1))
    placed = mixed.withColumn("own", F.coalesce(own, F.lit(0))).join(before, ["source", "block"]).withColumn("start", F.col("own") + F.col("ahead"))
    turns = F.least(F.col("repeats").cast("long"), F.ceil((F.col("demand") - F.col("start")) / F.col("of")))
    drawn = placed.where((F.col("start") < F.col("demand")) & (turns > 0)).withColumn("repeat", F.explode(F.sequence(F.lit(1), turns.cast("int"))))
    at = F.col("start") + (F.col("repeat") - 1) * F.col("of") + F.col("tokens") / 2
    # demand is D(u) = total * share * ((1 + tilt) u - tilt u^2); its inverse at the middle of the draw
    part = F.least(F.lit(1.0), at / F.col("demand"))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + F.col("tilt")) ** 2 - 4 * F.col("tilt") * part))
    position = F.when(F.abs("tilt") < 1e-9, part).otherwise(2 * part / (1 + F.col("tilt") + root))
    draws = stored(drawn.select("source", key, "repeat", "tokens", position.alias("position")))
    reached = draws.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("draws"), F.max("repeat").alias("repeats"))
    all_drawn = reached.agg(F.sum("drawn_tokens").alias("all_drawn"))
    got = F.coalesce("drawn_tokens", F.lit(0))
    share = F.when(F.col("all_drawn") > 0, got / F.col("all_drawn")).otherwise(0.0)
    aims = spark.createDataFrame([(p["source"], p["target"], p["tokens"]) for p in plans], "source string, target_share double, tokens long")
    shares = (
        aims.join(reached, "source", "left")
        .join(F.broadcast(all_drawn))  # one row
        .select(
            "source",
            "target_share",
            share.alias("reached_share"),
            "tokens",
            got.alias("drawn_tokens"),
            F.coalesce("draws", F.lit(0)).alias("draws"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
            (F.abs(share - F.col("target_share")) <= 0.01 * F.col("target_share")).alias("met"),
        )
    )
    ordered = draws.repartitionByRange(F.col("position")).sortWithinPartitions("position", key)
    return ordered, shares
