"""The best representative of each group of duplicate records, field by field.

Texts survive by token-level consensus: the group's texts are aligned one after the other to a growing profile
of columns, every text votes a token or a gap per column, and the existing text closest to what the columns
elect is taken. A text that was cut off doesn't vote beyond its end; where a text repeats itself, or says what
the texts of many groups say, its vote is a gap. So what is cut, repeated or foreign is what differs from the
elected columns, and a text that differs by more than a few tokens is not usable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.textnorm import number, plain
from lectern.session import stored

_CUT = re.compile(r"\s*(?:\.\.\.|…|\[truncated\]|\(abstract truncated\)|\[\.\.\.\])\s*$", re.I)
_LABEL = re.compile(r"^\s*(?:abstract|summary)\s*[:.\-]?\s+(?=[A-Z])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
#: Distinct texts of one group that are aligned in one task; the winners of several tasks are aligned again.
_GO = 4096
#: Tokens by which a usable text may exceed or fall short of the elected columns.
_SLACK = 3
_CELLS = 1 << 22


def parted(text: str) -> tuple[list[str], bool]:
    """Sentences of a text, spaces folded, and whether it was cut off."""
    text = text.rstrip()
    end = text[-24:]
    cut = _CUT.search(end) if end[-1:] in ".…])" else None
    body = _SPACE.sub(" ", (text[: len(text) - len(end) + cut.start()] if cut else text)).strip()
    parts = [p for p in _SENTENCE.split(_LABEL.sub("", body)) if p]
    return parts, bool(cut) or not parts or parts[-1][-1] not in ".!?)\"'”。！？"


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the best alignments of a with all beginnings of b (match 2, other token -1, gap -1), row by row."""
    rows = np.empty((len(a) + 1, len(b) + 1), np.int32)
    slope = np.arange(len(b) + 1, dtype=np.int32)
    rows[0] = -slope
    for i in range(1, len(a) + 1):
        above = rows[i - 1]
        row = above - 1
        np.maximum(row[1:], above[:-1] + np.where(b == a[i - 1], 2, -1), out=row[1:])
        rows[i] = np.maximum.accumulate(row + slope) - slope
    return rows


def align(a: np.ndarray, b: np.ndarray, cut: bool = False) -> np.ndarray:
    """For each token of b the place in a it stands beside, or -1 where a has a gap: a global alignment with gap costs.

    Equal beginnings and ends are no question; what is left of very long texts is parted in the middle of a
    by the scores from both ends. ``cut``: what a has beyond the end of b costs nothing.
    """
    out = np.full(len(b), -1, np.int64)
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = 0 if cut else int(differ[0]) if len(differ) else short - head
    out[:head] = np.arange(head)
    if tail:
        out[len(b) - tail :] = np.arange(len(a) - tail, len(a))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(x) or not len(y):
        return out
    if cut:  # as far as a goes that is best for all of b
        ends = _last(y, x)
        x = x[: int(np.argmax(ends))]
        inner = align(x, y)
    elif len(x) * len(y) > _CELLS and len(x) > 1:
        half = len(x) // 2
        before, after = _last(x[:half], y), _last(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(before + after))
        left, right = align(x[:half], y[:cut]), align(x[half:], y[cut:])
        inner = np.concatenate([left, np.where(right >= 0, right + half, -1)])
    else:
        inner = np.full(len(y), -1, np.int64)
        rows = _best(x, y)
        i, j = len(x), len(y)
        while i and j:
            here = rows[i, j]
            if here == rows[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1):
                i, j = i - 1, j - 1
                inner[j] = i
            elif here == rows[i - 1, j] - 1:
                i -= 1
            else:
                j -= 1
    out[head : len(b) - tail] = np.where(inner >= 0, inner + head, -1)
    return out


def _last(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The last row of ``_best`` without the others."""
    slope = np.arange(len(b) + 1, dtype=np.int32)
    row = -slope
    for token in a:
        above, row = row, row - 1
        np.maximum(row[1:], above[:-1] + np.where(b == token, 2, -1), out=row[1:])
        row = np.maximum.accumulate(row + slope) - slope
    return row


class Profile:
    """Columns of aligned tokens. Each aligned text is kept as the columns of its tokens, which votes are counted from."""

    def __init__(self) -> None:
        self.leaders = np.empty(0, np.int64)
        self.texts: list[tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]] = []

    def add(self, tokens: np.ndarray, own: np.ndarray, weight: float, cut: bool) -> None:
        """Align a text; ``own``: tokens that vote for themselves, in place of which others vote a gap."""
        place = align(self.leaders, tokens, cut)
        fresh = place < 0
        if fresh.any():
            # new columns come after the column that the token before them stands in
            anchor = np.maximum.accumulate(np.where(fresh, -1, place))
            new = np.cumsum(np.bincount(anchor[fresh] + 1, minlength=len(self.leaders) + 1))
            moved = np.arange(len(self.leaders)) + new[:-1]
            own_rank = np.arange(len(tokens)) - np.maximum.accumulate(np.where(fresh, -1, np.arange(len(tokens))))
            start = np.where(anchor >= 0, moved[anchor] if len(moved) else 0, -1)
            place = np.where(fresh, start + own_rank, moved[place] if len(moved) else 0)
            leaders = np.empty(len(self.leaders) + int(fresh.sum()), np.int64)
            leaders[moved] = self.leaders
            leaders[place[fresh]] = tokens[fresh]
            self.leaders = leaders
            self.texts = [(moved[p], t, o, w, c) for p, t, o, w, c in self.texts]
        self.texts.append((place, tokens, own, weight, cut))

    def elected(self) -> np.ndarray:
        """Of each column the token with the greatest weight, or -1 for a gap; a token wins a tie with a gap."""
        n = len(self.leaders)
        gap = np.zeros(n)
        for place, _, own, weight, cut in self.texts:
            votes = np.full(n, weight)
            votes[place[own]] = 0.0
            if cut:
                votes[(int(place[own][-1]) + 1 if own.any() else 0) :] = 0.0
            gap += votes
        columns = np.concatenate([p[o] for p, _, o, _, _ in self.texts])
        tokens = np.concatenate([t[o] for _, t, o, _, _ in self.texts])
        weights = np.concatenate([np.full(int(o.sum()), w) for _, _, o, w, _ in self.texts])
        winner, most = np.full(n, -1, np.int64), np.zeros(n)
        if len(columns):
            order = np.lexsort((tokens, columns))
            columns, tokens, weights = columns[order], tokens[order], weights[order]
            starts = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]) | (tokens[1:] != tokens[:-1])])
            total = np.add.reduceat(weights, starts)
            by = np.lexsort((-tokens[starts], total))  # the greatest comes last and stays
            winner[columns[starts][by]], most[columns[starts][by]] = tokens[starts][by], total[by]
        return np.where(most + 1e-9 >= gap, winner, -1)


def consensus(texts: list[tuple[list[str], bool, float]], common: set[int]) -> tuple[int, float, bool]:
    """Place of the text closest to the consensus of (sentences in normal form, cut off, weight), its distance in
    tokens, and whether it is usable. ``common``: numbers of sentences that stand in many groups.

    A usable text is not cut off, has no token whose vote was a gap for being repeated or common, and exceeds and lacks
    no more than a few tokens of what is elected.
    """
    ids: dict[str, int] = {}
    prepared = []
    for place, (parts, cut, weight) in enumerate(texts):
        seen: set[str] = set()
        tokens, own = [], []
        foreign = [number(part) in common for part in parts] + [False]
        for k, part in enumerate(parts):
            words = part.split()
            if cut and k == len(parts) - 1:
                words = words[:-1]  # where a text was cut its last word is no witness
            tokens += [ids.setdefault(w, len(ids)) for w in words]
            # what stands before a foreign sentence may have been cut off by it, and run into another one
            own += [part not in seen and not foreign[k] and not foreign[k + 1]] * len(words)
            seen.add(part)
        prepared.append((np.array(tokens, np.int64), np.array(own, bool), cut or foreign[-2], weight, place))
    profile = Profile()
    # the profile grows from what needs no gap: whole texts first, the longest before the others
    order = sorted(prepared, key=lambda p: (p[2] or not p[1].all(), -len(p[0]), texts[p[4]][0]))
    for tokens, own, cut, weight, _ in order:
        profile.add(tokens, own, weight, cut)
    goal = profile.elected()
    best = None
    for (tokens, own, cut, weight, place), (columns, *_) in zip(order, profile.texts):
        there = goal[columns]
        extra, missing = int((there < 0).sum()), int((goal >= 0).sum() - (there >= 0).sum())
        other = int(((there >= 0) & (there != tokens)).sum())
        usable = bool(len(tokens)) and not cut and bool(own.all()) and extra <= _SLACK and missing <= _SLACK
        key = (not usable, extra + missing + 2 * other, -weight, place)
        if best is None or key < best:
            best = key
    return best[3], float(best[1]), not best[0]


def _parsed(df: DataFrame, text: str) -> DataFrame:
    """df with cut, said (numbers of the sentences in order) and flat (their normal forms, one a line) instead of the text."""
    rest = [c for c in df.columns if c != text]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, said, flat = [], [], []
            for value in batch.column(0).to_pylist():
                parts, open_end = parted(value)
                forms = [" ".join(plain(p).split()) for p in parts]
                cut.append(open_end)
                said.append([number(f) for f in forms])
                flat.append("\n".join(forms))
            columns = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.bool_()), pa.array(said, pa.list_(pa.int64())), pa.array(flat, pa.string())], [*rest, "cut", "said", "flat"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(text, *rest).mapInArrow(of_batches, f"{schema}, cut boolean, said array<long>, flat string")


def best_text(df: DataFrame, group: str, text: str, row: str, weight: str, many: int = 5, stand_in: int = 40, with_text: bool = True) -> DataFrame:
    """(group, row, distance[, text]): of each group the row that holds the text closest to the consensus.

    Rows whose texts are alike but for spaces count as one text with their summed ``weight``; it is given by
    its least ``row``. Null texts and those below ``stand_in`` characters are none; a group whose texts are all
    cut off, repeated or mixed with what stands in ``many`` groups or more gives no row. Equal distances are
    settled by weight, then by the least row. Above 4,096 distinct texts a group is aligned in parts, and their
    winners again with the weights of their parts.
    """
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = (
        df.where(F.length(folded) >= stand_in)
        .select(F.col(group).alias("g"), folded.alias("t"), F.col(row).alias("r"), F.col(weight).cast("double").alias("w"))
        .groupBy("g", "t")
        .agg(F.min("r").alias("r"), F.sum("w").alias("w"))
    )
    parsed = stored(_parsed(rows, "t"))
    said = parsed.select("g", "r", F.explode(F.array_distinct("said")).alias("s"))
    common = said.groupBy("s").agg(F.countDistinct("g").alias("n")).where(F.col("n") >= many).select("s")
    marked = said.join(common, "s").groupBy("g", "r").agg(F.collect_list("s").alias("common"))  # at most a text's own sentences
    sizes = parsed.groupBy("g").agg(F.count("*").alias("n"))
    now = stored(parsed.join(marked, ["g", "r"], "left").join(sizes, "g").withColumn("common", F.coalesce("common", F.array().cast("array<long>"))))
    # a text alone is what it elects
    alone = now.where("n = 1").where(~F.col("cut") & (F.size("common") == 0) & (F.size("said") > 0) & (F.size(F.array_distinct("said")) == F.size("said")))
    elected = alone.select("g", "r", F.lit(0.0).alias("distance"))
    several = now.where("n > 1")
    kind = f"g {df.schema[group].dataType.simpleString()}, r {df.schema[row].dataType.simpleString()}, w double, distance double, good boolean"

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out = []
            for record in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if record[:2] != current:
                    if held:
                        out.append(won(held))
                    current, held = record[:2], []
                held.append(record)
            if out:
                yield of(out, batch)
        if held:
            yield of([won(held)], batch)

    def won(held: list[tuple]) -> tuple:
        place, distance, good = consensus([(flat.split("\n") if flat else [], cut, w) for _, _, _, w, cut, flat, _ in held], {s for x in held for s in x[6]})
        return held[place][0], held[place][2], sum(x[3] for x in held), distance, good

    def of(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*out))
        kinds = (batch.schema.field(0).type, batch.schema.field(2).type, pa.float64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "r", "w", "distance", "good"])

    while True:
        part = F.when(F.col("n") > _GO, F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / _GO))).otherwise(0).alias("part")
        dealt = several.select("g", part, "r", "w", "cut", "flat", "common").repartition("g", "part").sortWithinPartitions("g", "part", "r")
        won_ = stored(dealt.mapInArrow(elect, kind))
        counts = won_.groupBy("g").agg(F.count("*").alias("n"))
        elected = elected.union(won_.join(counts.where("n = 1"), "g").where("good").select("g", "r", "distance"))
        again = counts.where("n > 1")
        if again.isEmpty():
            break
        several = won_.join(again, "g").select("g", "r", "w", "n").join(parsed.select("g", "r", "cut", "flat"), ["g", "r"]).join(marked, ["g", "r"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    found = elected.select(F.col("g").alias(group), F.col("r").alias(row), "distance")
    if not with_text:
        return found
    return found.join(df.select(F.col(row).alias("_r"), F.col(group).alias("_g"), folded.alias(text)).distinct(), (F.col(row) == F.col("_r")) & (F.col(group) == F.col("_g"))).select(group, row, text, "distance")


def most_trusted(df: DataFrame, group: str, fields: dict[str, tuple], row: str) -> DataFrame:
    """(group, field, row, value): of each field the value with the greatest rank.

    ``fields``: name -> (value as written, its normal form or null where unusable, rank of the row, rank once
    more by support). Values with one normal form support each other: a value's rank is its best row's, then
    the number of its rows, then the second rank's maximum; ties go to the least normal form. The row given is
    the least that holds the value, among those with a rank. A field without usable value gives no row.
    """
    entries = F.array(
        *(
            F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), norm.cast("string").alias("norm"), rank.cast("double").alias("rank"), late.cast("double").alias("late"))
            for name, (value, norm, rank, late) in fields.items()
        )
    )
    long = df.select(F.col(group).alias("g"), F.col(row).alias("r"), F.explode(entries).alias("e")).select("g", "r", "e.*").where("norm is not null and norm <> '' and rank is not null")
    values = long.groupBy("g", "field", "norm").agg(
        F.max("rank").alias("rank"), F.count("*").alias("n"), F.max("late").alias("late"), F.min("r").alias("r"), F.min_by("value", "r").alias("value")
    )
    order = Window.partitionBy("g", "field").orderBy(F.desc("rank"), F.desc("n"), F.desc("late"), "norm")
    best = values.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select(F.col("g").alias(group), "field", F.col("r").alias(row), "value")
