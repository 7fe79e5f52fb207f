"""Long exact spans shared between records.

Windows are winnowed: of every run of ``span - gram + 1`` consecutive ``gram``-grams the one of least hash
is an anchor, so any two equal stretches of ``span`` characters have an anchor in common at the same place.
A first pass makes a sketch of each partition's anchors (count-min, two rows of saturating counters); the
sketches are merged by block of counters. A second pass lets only anchors through whose counters say twice
or more, which loses none, and groups those exactly. Matches are then checked and extended character by
character, so neither a hash nor a counter decides anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import stored

_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)
_BLOCK_BITS = 20
_ROWS = 2


@dataclass(frozen=True)
class SpanOptions:
    """span: least length shared, in code points. gram: length of an anchor. slots: counters per window of
    the sketch. max_counter_bits: bound of the sketch (two bitmaps of 2**bits bits are broadcast, 64 MB at
    28); beyond it more windows pass the first filter and none are lost: those cost 28 bytes each, as their texts are
    fetched only after the exact grouping. hot: occurrences of an anchor from
    which its windows of the whole span are grouped instead of paired."""

    span: int = 160
    gram: int = 112
    slots: int = 8
    max_counter_bits: int = 28
    hot: int = 48


def _chunks(texts: list[str], span: int, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Code points of about ``size`` characters at a time, and (text, place in it, place in the chunk) of
    each piece; pieces of a longer text overlap by span - 1, a zero parts neighbours."""
    codes: list[np.ndarray] = []
    at: list[tuple[int, int, int]] = []
    total = 0
    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        for lo in range(0, max(1, len(text) - span + 1), size):
            piece = text[lo : lo + size + span - 1]
            if total and total + len(piece) > size + span:
                yield np.concatenate(codes), at
                codes, at, total = [], [], 0
            at.append((i, lo, total))
            codes.append(np.frombuffer((piece + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32))
            total += len(piece) + 1
    if codes:
        yield np.concatenate(codes), at


class _Hasher:
    """Hashes of all grams of a chunk by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.empty(0, np.uint64)

    def __call__(self, codes: np.ndarray, at: list[tuple[int, int, int]], gram: int) -> np.ndarray:
        n = len(codes)
        if len(self.powers) < n:
            self.powers = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
            self.inverse = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 2**64), np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.powers[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * self.inverse[: n - gram + 1]
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        for k in range(len(at)):  # grams that reach beyond their text are none
            end = at[k + 1][2] if k + 1 < len(at) else n
            h[max(0, end - gram) : end] = _NONE
        return h


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over every run of ``width`` values."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, fill, values.dtype)]).reshape(-1, width)
    before = ufunc.accumulate(rows, axis=1).ravel()
    after = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(after[: n - width + 1], before[width - 1 : n])


def anchors(codes: np.ndarray, at: list[tuple[int, int, int]], options: SpanOptions, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Places in the chunk and hashes of its anchors; of equal hashes in a run all are anchors."""
    h = hasher(codes, at, options.gram)
    width = options.span - options.gram + 1
    least = _sliding(h, width, np.minimum, int(_NONE))
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum, 0)
    places = np.flatnonzero((h == most) & (h != _NONE))
    return places, h[places]


def _counters(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(2**bits - 1)
    return [((h >> np.uint64(shift)) & mask).astype(np.uint32) for shift in (0, 64 - bits)]


def _sketch(df: DataFrame, text: str, options: SpanOptions, bits: int) -> DataFrame:
    """(row, block, bits): merged sketch; a set bit marks a counter that says twice or more."""
    block_bits = min(_BLOCK_BITS, bits)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = _Hasher(), []
        for batch in batches:
            for codes, at in _chunks(batch.column(0).to_pylist(), options.span):
                found.append(anchors(codes, at, options, hasher)[1])
        if not found:
            return
        every = np.concatenate(found)
        rows, blocks, once, more = [], [], [], []
        for row, counters in enumerate(_counters(every, bits)):
            ids, counts = np.unique(counters, return_counts=True)
            cuts = np.searchsorted(ids, np.arange(0, 2**bits + 1, 2**block_bits, dtype=np.uint64))
            for block in np.flatnonzero(np.diff(cuts)):
                own = ids[cuts[block] : cuts[block + 1]] & np.uint32(2**block_bits - 1)
                twice = own[counts[cuts[block] : cuts[block + 1]] > 1]
                rows.append(row)
                blocks.append(int(block))
                once.append(zlib.compress(np.diff(own, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1))
                more.append(twice.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["row", "block", "once", "more"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(2**block_bits, np.uint8)
        for once, more in zip(pdf["once"], pdf["more"]):
            ids = np.cumsum(np.frombuffer(zlib.decompress(once), np.uint32))
            counts[ids] = np.minimum(counts[ids] + 1, 2)
            counts[np.frombuffer(more, np.uint32)] = 2
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "block": [pdf["block"].iloc[0]], "bits": [zlib.compress(np.packbits(counts == 2).tobytes(), 1)]})

    partial = df.select(text).mapInArrow(of_partition, "row int, block int, once binary, more binary")
    return partial.groupBy("row", "block").applyInPandas(merged, "row int, block int, bits binary")


def _repeated_anchors(rows: DataFrame, options: SpanOptions, bits: int) -> DataFrame:
    """(doc, tid, h, pos) of the anchors that the sketch says are repeated; ``rows``: (key, tid, text)."""
    block_bits = min(_BLOCK_BITS, bits)
    bitmaps_ = [np.zeros(2**bits // 8, np.uint8) for _ in range(_ROWS)]
    for row, block, packed in _sketch(rows, "text", options, bits).collect():  # bounded: _ROWS bitmaps of 2**bits
        size = 2**block_bits // 8
        bitmaps_[row][block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast([zlib.compress(r.tobytes(), 1) for r in bitmaps_])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, hasher = None, _Hasher()
        for batch in batches:
            if bitmaps is None:
                bitmaps = [np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value]
            keys, tids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for codes, at in _chunks(texts, options.span):
                places, h = anchors(codes, at, options, hasher)
                keep = np.ones(len(h), bool)
                for counters, bitmap in zip(_counters(h, bits), bitmaps):
                    keep &= (bitmap[counters >> 3] >> (7 - (counters & 7)).astype(np.uint8)) & 1 == 1
                places, h = places[keep], h[keep]
                if not len(h):
                    continue
                starts = np.array([x[2] for x in at])
                piece = np.searchsorted(starts, places, "right") - 1
                doc = pa.array(np.array([x[0] for x in at])[piece])
                pos = places - starts[piece] + np.array([x[1] for x in at])[piece]
                yield pa.RecordBatch.from_arrays([keys.take(doc), tids.take(doc), pa.array(h.view(np.int64)), pa.array(pos, pa.int32())], ["doc", "tid", "h", "pos"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "tid", "text").mapInArrow(passing, f"doc {kind}, tid long, h long, pos int")


def _contexts(counted: DataFrame, rows: DataFrame, options: SpanOptions) -> DataFrame:
    """counted (doc, tid, h, pos, n) with off and ctx: the text from span - gram characters before the anchor, which begins
    at off in it, to span characters after its start. Only texts with a repeated anchor travel."""
    reach = options.span - options.gram
    places = counted.groupBy("doc", "tid").agg(F.collect_list(F.struct("h", "pos", "n")).alias("places"))  # one text's anchors
    texts = rows.dropDuplicates(["key", "tid"]).join(places, (F.col("key") == F.col("doc")) & (rows["tid"] == places["tid"])).select("doc", "text", F.explode("places").alias("p"))
    at = texts.select("doc", "p.*", F.least("p.pos", F.lit(reach)).alias("off"), "text")
    return at.select("doc", "h", "pos", "n", "off", F.substr("text", F.col("pos") - F.col("off") + 1, F.col("off") + options.span).alias("ctx"))


def _common(a: Column, b: Column, most: int) -> Column:
    """Length of the common beginning of two strings of at most ``most`` characters, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    found = F.aggregate(
        steps, F.lit(0), lambda done, step: done + F.when(F.substr(a, done + 1, step) == F.substr(b, done + 1, step), step).otherwise(0)
    )
    return F.least(found, F.length(a), F.length(b))


@dataclass
class SharedSpans:
    """copies: (doc, rep, length) of every text long enough; rep is the least doc of equal text.
    matches: (doc_a, start_a, doc_b, start_b, length) between representatives, each at least a span long;
    their union covers exactly what two different texts share, except for windows of hot anchors.
    hot: (doc, start) of windows of exactly a span, each in two different texts or more; win names the window."""

    copies: DataFrame
    matches: DataFrame
    hot: DataFrame


def shared_spans(df: DataFrame, key: str, text: str, options: SpanOptions = SpanOptions()) -> SharedSpans:
    """Everything that stands word for word in two records of ``df``.

    Rows with a null key or text and texts below the span share nothing. A key that is repeated is one
    record: its texts count together, and what only its own rows share is not reported.
    """
    span, reach = options.span, options.span - options.gram
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= span))
    digests = stored(rows.select("key", F.sha2("text", 256).alias("digest"), F.length("text").alias("length")).distinct())
    least = digests.groupBy("digest").agg(F.min("key").alias("rep"))
    copies = stored(digests.join(least, "digest").select(F.col("key").alias("doc"), "rep", "length"))
    chars = digests.agg(F.sum("length")).first()[0] or 0
    windows = max(1, int(chars * 2 / (reach + 2)))
    bits = min(options.max_counter_bits, max(16, (windows * options.slots - 1).bit_length()))
    other = copies.where("doc <> rep").select("doc")
    told = rows.withColumn("tid", F.xxhash64("text"))
    passed = stored(_repeated_anchors(told, options, bits).join(other, "doc", "left_anti"))
    # counted before the shuffle and joined back, so an anchor that stands anywhere is never one group
    several = passed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("h", "n")
    counted = stored(_contexts(passed.join(several, "h"), told, options))
    cold = counted.where(F.col("n") <= options.hot).select(
        "doc", "h", "pos", F.reverse(F.substr("ctx", F.lit(1), F.col("off"))).alias("left"), F.substr("ctx", F.col("off") + 1, F.lit(span)).alias("right")
    )
    a, b = (cold.select(F.col("h"), *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "pos", "left", "right"))) for x in "ab")
    pairs = a.join(b, "h").where("doc_a < doc_b")
    pairs = pairs.withColumn("ahead", _common(F.col("right_a"), F.col("right_b"), span)).withColumn("back", _common(F.col("left_a"), F.col("left_b"), reach))
    matches = (
        pairs.where((F.col("ahead") >= options.gram) & (F.col("ahead") + F.col("back") >= span))
        .select("doc_a", (F.col("pos_a") - F.col("back")).alias("start_a"), "doc_b", (F.col("pos_b") - F.col("back")).alias("start_b"), (F.col("ahead") + F.col("back")).alias("length"))
        .distinct()
    )
    windows_of_hot = (
        counted.where(F.col("n") > options.hot)
        .select("doc", "pos", "off", "ctx", F.explode(F.sequence(F.lit(0), F.col("off"))).alias("at"))
        .select("doc", (F.col("pos") - F.col("off") + F.col("at")).alias("start"), F.substr("ctx", F.col("at") + 1, F.lit(span)).alias("win"))
        .where(F.length("win") == span)
        .distinct()
    )
    windows_of_hot = stored(windows_of_hot)
    several_wins = windows_of_hot.groupBy("win").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a <> _b").select("win")
    hot = windows_of_hot.join(several_wins, "win").select("doc", "start", "win")
    return SharedSpans(copies, stored(matches), stored(hot))


def sharing_pairs(found: SharedSpans) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b: all records that have a span in common, copies included."""
    a, b = (found.hot.select("win", F.col("doc").alias(f"doc_{x}")) for x in "ab")
    reps = found.matches.select("doc_a", "doc_b").union(a.join(b, "win").where("doc_a < doc_b").select("doc_a", "doc_b")).distinct()
    members = found.copies.select("doc", "rep").distinct()
    one, two = (members.select(F.col("rep").alias(f"rep_{x}"), F.col("doc").alias(f"m_{x}")) for x in "ab")
    across = reps.join(one, F.col("doc_a") == F.col("rep_a")).join(two, F.col("doc_b") == F.col("rep_b")).select("m_a", "m_b")
    within = one.join(two, F.col("rep_a") == F.col("rep_b")).where("m_a < m_b").select("m_a", "m_b")
    return across.union(within).where("m_a <> m_b").select(F.least("m_a", "m_b").alias("doc_a"), F.greatest("m_a", "m_b").alias("doc_b")).distinct()


def stretches(found: SharedSpans, options: SpanOptions = SpanOptions()) -> DataFrame:
    """(doc, start, end): the maximal stretches of each record that stand in another record as well.

    Of a text with exact copies this is the whole text. Found for representatives and given to their copies.
    """
    m = found.matches
    parts = (
        m.select(F.col("doc_a").alias("rep"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end"))
        .union(m.select("doc_b", "start_b", F.col("start_b") + F.col("length")))
        .union(found.hot.select("doc", "start", F.col("start") + options.span))
    )
    whole = found.copies.where("doc <> rep").select("rep", F.lit(0).alias("start"), F.col("length").alias("end")).distinct()
    order = Window.partitionBy("rep").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        parts.union(whole)
        .withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("rep", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return found.copies.select("doc", "rep").distinct().join(islands, "rep").select("doc", "start", "end")
