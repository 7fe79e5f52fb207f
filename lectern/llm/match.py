"""Matching records of works across sources without a common key.

Candidates come from blocks (identifiers, titles, abstracts' sentences, pairs of a title's rarest words),
never from a comparison of all with all. Each candidate pair gets a vector of similarities; a regularised
mixture of two Gaussians, one of matches and one of the rest, is fitted to all vectors without labels by
expectation-maximisation. Between its rounds transitivity is enforced: of three pairs among three records
the third is at least as sure as the other two together, unless the two works can't be one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textnorm as N
from lectern.operators.components import components
from lectern.session import stored

#: The similarities, each 0..1 or null where a record has nothing to compare.
FEATURES = ("title", "names", "ids", "year", "abstract", "venue")


@dataclass(frozen=True)
class MatchOptions:
    """block: rows of a block of words from which on its rows meet by what they share besides, which finds the same pairs.
    common: share of all records, and stated: number of them, beyond which a sentence under ever other titles is no evidence.
    steps: grid on which similarities are counted for the fit (all pairs count; with the values that identifiers,
    years and venues can have, the grid has at most 150,000 cells, which bounds what the driver sees).
    ridge: added to the variance of each similarity, more for identifiers, as a slip in one makes it differ
    altogether. rounds: steps of expectation-maximisation under transitivity. sure: posterior of a link."""

    block: int = 40
    common: float = 1 / 2000
    stated: int = 40
    steps: tuple[float, ...] = (0.05, 0.1, 0.5, 0.2, 0.1, 0.5)
    ridge: tuple[float, ...] = (0.01, 0.01, 0.06, 0.01, 0.01, 0.03)
    rounds: int = 2
    sure: float = 0.5


_PREPARED = (
    "rid long, side int, title string, words array<int>, kind string, names array<int>, doi long, pre long, pmid long, year int, "
    "abstract array<long>, venue long"
)
_STOP = frozenset("a an the of and in on for with from to by under at as or versus vs how towards effects study analysis".split())


def _short(word: str) -> int:
    """31 bits of a word's number: within one record or block of records two words don't meet in them."""
    return N.number(word) & 0x7FFFFFFF


def _prepare(row: tuple) -> tuple:
    title, names, year, doi, abstract, pmid, preprint, venue = row
    words = N.words_of(title)
    raw = (title or "").rstrip()
    cut = raw.endswith(("...", "…", "(", ",", ":", "-", "Part"))
    if raw.endswith(("...", "…")) and len(words) > 1 and raw.rstrip(".…")[-1:].isalnum():
        words = words[:-1]  # the last word is likely cut as well
    kind, words = N.kind_of(words, cut)
    content = {_short(w) for w in words if w not in _STOP and len(w) > 2}
    if not names or N.is_nobody(names):
        people: set[int] = set()
    else:
        people = {_short(w) for w in N.words_of(names) if len(w) > 3}
    d = N.doi_of(doi)
    pre = N.preprint_of(preprint) or (N.preprint_of(d) if "/pre" in d or "arxiv" in d else "")
    if d and (pre and d.endswith(pre) or not any(c.isdigit() for c in d.partition("/")[2])):
        d = ""  # a preprint's own number, or a stand-in, says nothing about the published work
    p = N.digits_of(pmid)
    said = list(dict.fromkeys(N.number(s) for s in N.sentences_of(abstract) if len(s) > 20))
    return (
        " ".join(words),
        list(content),
        kind,
        list(people),
        N.number(d) if d else None,
        N.number(pre) if pre else None,
        N.number(p) if p else None,
        N.year_of(year),
        said,
        N.number(" ".join(N.words_of(venue))) if venue and venue.strip() else None,
    )


def prepare(df: DataFrame) -> DataFrame:
    """Normal forms of records (rid, side, title, names, year, doi, abstract, pmid, preprint, venue)."""
    fields = ("title", "names", "year", "doi", "abstract", "pmid", "preprint", "venue")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        names = ["title", "words", "kind", "names", "doi", "pre", "pmid", "year", "abstract", "venue"]
        for batch in batches:
            out = [_prepare(row) for row in zip(*(batch.column(f).to_pylist() for f in fields))]
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("side"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["rid", "side", *names]
            )

    return df.select("rid", "side", *fields).mapInArrow(of_batches, _PREPARED)


def _keys(records: DataFrame) -> DataFrame:
    """(key, rid, same): the blocks of each record; same: whether the key is an equal identifier, title or sentence.

    Of an abstract its first sentence is a key and the one of least number, which copies that lost their beginning
    or their end have in common. Of a title the pairs of its three rarest words are, whatever the year.
    """
    df = F.col("df")
    seen = records.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    rare = (
        records.select("rid", F.explode("words").alias("w"))
        .join(seen, "w")
        .groupBy("rid")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(df, F.col("w")))), 1, 3).alias("r"))  # at most a title's words
    )
    pair = [(0, 1), (0, 2), (1, 2)]
    at = lambda i: F.get("r", F.lit(i))["w"]
    pairs = [F.when(F.size("r") > j, F.xxhash64(F.lit("p"), F.least(at(i), at(j)), F.greatest(at(i), at(j)))) for i, j in pair]
    by_words = rare.select(F.explode(F.array_distinct(F.array_compact(F.array(*pairs)))).alias("key"), "rid", F.lit(False).alias("same"))
    short = F.size("words") < 3
    named = F.transform("names", lambda n: F.xxhash64(F.lit("n"), F.col("title"), n))
    single = F.array(
        F.when(F.col("doi").isNotNull(), F.xxhash64(F.lit("d"), "doi")),
        F.when(F.col("pre").isNotNull(), F.xxhash64(F.lit("a"), "pre")),
        F.when(F.col("pmid").isNotNull(), F.xxhash64(F.lit("m"), "pmid")),
        F.when(~short, F.xxhash64(F.lit("t"), "title")),
        F.when(F.size("abstract") > 0, F.xxhash64(F.lit("s"), F.get("abstract", F.lit(0)))),
        F.when(F.size("abstract") > 1, F.xxhash64(F.lit("s"), F.array_min("abstract"))),
    )
    every = F.concat(F.array_compact(single), F.when(short & (F.col("title") != ""), named).otherwise(F.array().cast("array<long>")))
    return by_words.union(records.select(F.explode(F.array_distinct(every)).alias("key"), "rid", F.lit(True)))


def without_common(records: DataFrame, options: MatchOptions) -> DataFrame:
    """records without the sentences that stand in abstracts of works of all kinds, as what a page says about itself.

    Such a sentence is a key of more than ``common`` of all records, and of more than ``stated``, under titles most of
    which differ; so there are at most two for each 1 / common records. What becomes a key without it is judged in turn.
    """
    least = max(options.stated, options.common * records.count())
    common: list[int] = []
    while True:
        # read anew and not stored: a list of them costs less than another copy of all abstracts
        rest = records.withColumn("abstract", F.filter("abstract", lambda s: ~s.isin(common))) if common else records
        first = F.array_distinct(F.array_compact(F.array(F.get("abstract", F.lit(0)), F.array_min("abstract"))))
        keyed = rest.select(F.explode(first).alias("s"), "title")
        often = keyed.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > least)  # bounded as said above
        titles = keyed.join(F.broadcast(often), "s").groupBy("s", "n").agg(F.countDistinct("title").alias("titles"))
        found = [r.s for r in titles.where("titles > 0.6 * n").collect()]
        if not found:
            return rest
        common += found


def copies(records: DataFrame) -> DataFrame:
    """(rid, first) of the records that are alike in everything to an earlier one, with the first of them."""
    # a hash passes over nulls and the bounds of arrays, so it is told of both
    told = lambda c, kind: F.coalesce(F.size(c), F.lit(-1)) if kind.startswith("array") else F.col(c).isNull()
    form = F.xxhash64(*(x for c, kind in records.dtypes if c not in ("rid", "side") for x in (told(c, kind), F.col(c))))
    return records.select("rid", form.alias("form")).select("rid", F.min("rid").over(Window.partitionBy("form")).alias("first")).where("rid <> first")


def candidates(records: DataFrame, options: MatchOptions) -> DataFrame:
    """(a, b, same, worth, title, names) with a < b: distinct pairs of records that share a block; same: one of equal
    identifiers, titles or sentences, which are all taken. Of those that share words only, all that have ``_evidence``
    are worth a comparison, and as a measure of chance stand those of a block's least record without it, with their overlaps.

    Records that are alike in everything count once, and each is paired with the least of them. No pair depends on the
    size of a block or of the data: the rows of a block of more than ``block`` meet by whatever else evidence asks for.
    """
    every = stored(_keys(records))
    again = stored(copies(records))
    keys = every.join(again, "rid", "left_anti")
    block = Window.partitionBy("key")  # one shuffle for the rows and their number
    sized = stored(keys.select("*", F.count("*").over(block).alias("n"), F.min("rid").over(block).alias("least")).where("n > 1"))
    alike = again.join(every, "rid", "left_semi").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    equal = sized.where("same").select("key", "rid")
    same = _within(equal).union(alike).select("a", "b", F.lit(True).alias("same"), F.lit(True).alias("worth"), *(F.lit(None).cast("double").alias(c) for c in ("title", "names")))
    content = records.select("rid", "words", "names")
    by_words = sized.where("not same")
    small = by_words.where(F.col("n") <= options.block).select("key", "rid", "least").join(content, "rid")
    near = _sided(small, "a", "key", "least").join(_sided(small, "b", "key", "least"), ["key", "least"]).where("a < b").withColumn("chance", F.col("a") == F.col("least"))  # one shuffle for both sides
    # few blocks are large: their rows alone are joined with what they meet by
    large = stored(stored(by_words.where(F.col("n") > options.block).select("key", "rid", "n", "least")).join(content, "rid"))
    held = large.select("rid", "words", "names").dropDuplicates(["rid"])
    far = stored(_met(large)).join(_sided(held, "b"), "b").join(_sided(held, "a"), "a")
    words, names = ("words_a", "words_b"), ("names_a", "names_b")
    worth = _evidence(words, names)
    judged = [
        x.where(worth | F.col("chance")).select("a", "b", F.lit(False).alias("same"), worth.alias("worth"), *(F.when(~worth, _overlap(*c)).alias(n) for c, n in ((words, "title"), (names, "names"))))
        for x in (near, far)
    ]
    found = reduce(DataFrame.union, [same, *judged])
    return found.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("same", "worth", "title", "names")))


def _sided(rows: DataFrame, side: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.col("rid").alias(side), F.col("words").alias(f"words_{side}"), F.col("names").alias(f"names_{side}"))


def _within(rows: DataFrame) -> DataFrame:
    """(a, b) of all rows (key, rid) of one key, a < b."""
    return rows.select("key", F.col("rid").alias("a")).join(rows.select("key", F.col("rid").alias("b")), "key").where("a < b").select("a", "b")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, chance) of rows (key, rid, n, least, words, names) of blocks of two words: all pairs that may have evidence,
    which are those with another word or a name in common, and of titles of two words those where one has no names;
    chance: those of a block's least row."""
    marks = F.concat(*(F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(c == "words").alias("word"))) for c in ("words", "names")))  # noqa: B023
    told = stored(rows.select("key", "rid", "n", F.explode(marks).alias("m")).select("key", "rid", "n", "m.*"))
    count = stored(told.groupBy("key", "w", "word").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m > 1"))
    # words of all rows are the key's own two, unless there are more, so that every pair has three
    third = count.where("word and m = n").groupBy("key").agg(F.min("w").alias("w"), F.lit(True).alias("word"), F.count("*").alias("c")).where("c > 2").select("key", "w", "word")
    parting = count.where("m < n or not word").select("key", "w", "word").union(third)
    shared = _within(told.join(parting, ["key", "w", "word"]).select(F.xxhash64("key", "w", "word").alias("key"), "rid"))
    bare, nameless = F.size("words") < 3, F.size("names") == 0
    lone = [rows.where(x).select("key", F.col("rid").alias("x")).join(rows.where(y).select("key", F.col("rid").alias("y")), "key") for x, y in ((bare & nameless, F.lit(True)), (bare, nameless))]
    unnamed = lone[0].union(lone[1]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    chance = rows.where("least < rid").select(F.col("least").alias("a"), F.col("rid").alias("b"), F.lit(True).alias("chance"))
    return shared.union(unnamed).withColumn("chance", F.lit(False)).union(chance).groupBy("a", "b").agg(F.max("chance").alias("chance"))


def _evidence(words: tuple[str, str], names: tuple[str, str]) -> Column:
    """Whether two records that share words are worth a comparison: by three words of their titles (all, of a shorter
    one, unless both have names of which none is shared), or by two and two names (one, where only one is given). The
    rule is the same at any size of the data."""
    shared = [F.size(F.array_intersect(*x)) for x in (words, names)]
    least = [F.least(F.size(x[0]), F.size(x[1])) for x in (words, names)]
    three, two = F.least(F.lit(3), least[0]), F.least(F.lit(2), least[0])
    # the words asked for at no, one, two shared names; each intersection is written, and so computed, once
    asked = F.array(F.lit(3), F.when(least[1] == 1, two).otherwise(three), two)
    return shared[0] >= F.when(least[1] == 0, three).otherwise(F.get(asked, F.least(F.lit(2), shared[1])))


def _overlap(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared / least)


def similarities(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, apart, *FEATURES) of each pair; apart: the titles say that these are two works."""
    sides = [records.select(*(F.col(c).alias(f"{c}_{x}") for c in records.columns)) for x in "ab"]
    both = pairs.join(sides[0], F.col("a") == F.col("rid_a")).join(sides[1], F.col("b") == F.col("rid_b"))
    ta, tb = F.col("title_a"), F.col("title_b")
    least = F.least(F.length(ta), F.length(tb))
    edits = F.levenshtein(F.substr(ta, F.lit(1), least), F.substr(tb, F.lit(1), least))
    as_written = F.when(ta == tb, 1.0).otherwise(1 - edits / least)
    words = F.when(F.least(F.size("words_a"), F.size("words_b")) > 1, _overlap("words_a", "words_b")).otherwise(0.0)
    # a title of a word or two is no evidence, nor is what is left of one that was cut off soon
    title = F.when(F.least(F.size("words_a"), F.size("words_b")) > 1, F.when(words == 1, 1.0).otherwise(F.greatest(F.when(least >= 15, as_written).otherwise(0.0), words)))
    same = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)) for c in ("doi", "pmid", "pre")))
    differ = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False)) for c in ("doi", "pmid", "pre")))
    tail = [F.element_at(F.split(f"kind_{x}", ":"), 2) for x in "ab"]
    notice = [F.element_at(F.split(f"kind_{x}", ":"), 1) for x in "ab"]
    return both.select(
        "a",
        "b",
        ((notice[0] != notice[1]) | ((tail[0] != tail[1]) & (tail[0] != "?") & (tail[1] != "?"))).alias("apart"),
        title.alias("title"),
        _overlap("names_a", "names_b").alias("names"),
        F.when(same, 1.0).when(differ, 0.0).alias("ids"),
        F.when(F.col("year_a").isNotNull() & F.col("year_b").isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(F.col("year_a") - F.col("year_b")) * 0.4)).alias("year"),
        _overlap("abstract_a", "abstract_b").alias("abstract"),
        (F.col("venue_a") == F.col("venue_b")).cast("double").alias("venue"),
    )


class Mixture:
    """Two Gaussians with diagonal, ridged covariance; what a vector lacks is left out of its density."""

    def __init__(self, ridge: tuple[float, ...]) -> None:
        self.ridge = np.array(ridge)
        self.share = 0.5
        self.mean = self.var = np.empty(0)

    def step(self, x: np.ndarray, weight: np.ndarray, gamma: np.ndarray) -> None:
        there = ~np.isnan(x)
        value = np.nan_to_num(x)
        self.share = float(np.clip((weight * gamma).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4))
        means, variances = [], []
        for part in (gamma, 1 - gamma):
            w = (weight * part)[:, None] * there
            total = w.sum(0) + 1e-6
            mean = (w * value).sum(0) / total
            means.append(mean)
            variances.append((w * (value - mean) ** 2).sum(0) / total + self.ridge)
        self.mean, self.var = np.array(means), np.array(variances)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        value = np.nan_to_num(x)
        log = [
            (np.where(there, -0.5 * ((value - m) ** 2 / v + np.log(v)), 0)).sum(1) + np.log(p)
            for m, v, p in zip(self.mean, self.var, (self.share, 1 - self.share))
        ]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -60, 60)))

    def column(self) -> Column:
        """The posterior as an expression over FEATURES."""
        log = []
        for m, v, p in zip(self.mean, self.var, (self.share, 1 - self.share)):
            terms = [F.coalesce(-0.5 * ((F.col(f) - float(mi)) ** 2 / float(vi) + float(np.log(vi))), F.lit(0.0)) for f, mi, vi in zip(FEATURES, m, v)]
            log.append(reduce(lambda a, b: a + b, terms) + float(np.log(p)))
        return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), log[1] - log[0]))))


def fit(vectors: DataFrame, chance: DataFrame, options: MatchOptions, gamma: str | None = None, model: Mixture | None = None) -> Mixture:
    """Expectation-maximisation over all vectors, counted on a grid; ``gamma``: a column of given posteriors to start from.

    ``chance``: (title, names) of the pairs that are no candidates for want of evidence. They show what agrees by
    chance, and count together as much as all vectors, as their number grows faster than the data.
    """
    grid = [(F.round(F.col(f) / step) * step).alias(f) for f, step in zip(FEATURES, options.steps)]
    given = F.avg(gamma) if gamma else F.lit(None).cast("double")
    cells = vectors.select(*grid, *([gamma] if gamma else [])).groupBy(*FEATURES).agg(F.count("*").alias("weight"), given.alias("given")).toPandas()
    far = chance.select(*grid[:2]).groupBy(*FEATURES[:2]).agg(F.count("*").alias("weight")).toPandas()
    model = model or Mixture(options.ridge)
    if not len(cells):
        model.step(np.zeros((1, len(FEATURES))), np.ones(1), np.full(1, 0.5))
        return model
    far["weight"] *= cells["weight"].sum() / max(1, far["weight"].sum())
    cells = pd.concat([cells, far.reindex(columns=cells.columns)], ignore_index=True) if len(far) else cells
    x, weight = cells[list(FEATURES)].to_numpy(float), cells["weight"].to_numpy(float)
    if gamma:
        start = cells["given"].fillna(0.0).to_numpy(float)
    else:
        # begin with what agrees in what it has, as nothing is labelled
        start = (np.nanmean(np.where(np.isnan(x), 0.4, x), axis=1) > 0.62).astype(float) * 0.98 + 0.01
    model.step(x, weight, start)
    for _ in range(60 if not gamma else 5):
        was = model.mean.copy()
        model.step(x, weight, model.posterior(x))
        if np.abs(was - model.mean).max() < 1e-4:
            break
    return model


def _transitive(scored: DataFrame, options: MatchOptions) -> DataFrame:
    """scored with ``gamma`` raised to the product of two sure pairs over a third record, or, where the works are apart, kept at nothing."""
    strong = scored.where((F.col("gamma") >= 0.5) & ~F.col("apart")).select("a", "b", "gamma")
    both = strong.select("a", "b", "gamma").union(strong.select(F.col("b"), F.col("a"), F.col("gamma")))
    one, two = both.select(F.col("a").alias("mid"), F.col("b").alias("a"), F.col("gamma").alias("g1")), both.select(F.col("a").alias("mid"), F.col("b").alias("b"), F.col("gamma").alias("g2"))
    # the weak are few, and stored at each step they are known to be: then only they travel
    weak = stored(scored.where((F.col("gamma") < 0.5) & (F.col("gamma") > 0.02) & ~F.col("apart")).select("a", "b"))
    thirds = stored(weak.join(one, "a")).join(two, ["mid", "b"])
    raised = stored(thirds.groupBy("a", "b").agg(F.max(F.col("g1") * F.col("g2")).alias("by_third"), F.count("*").alias("thirds")))
    # one third alone may itself be the mistake: two thirds, or one that is as good as certain
    return scored.join(raised, ["a", "b"], "left").withColumn(
        "gamma",
        F.when(F.col("apart"), 0.0)
        .when((F.col("thirds") > 1) | (F.col("by_third") > 0.98), F.greatest("gamma", F.col("by_third") * 0.9))
        .otherwise(F.col("gamma")),
    ).drop("by_third", "thirds")


def match(records: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """(a, b, apart, gamma, *FEATURES) of all candidate pairs of prepared records, with their posterior; see ``with_copies``."""
    records = without_common(records, options)
    pairs = stored(candidates(records, options))
    chance = pairs.where("not worth").select("title", "names")
    vectors = stored(similarities(pairs.where("worth").select("a", "b"), records))
    model = fit(vectors, chance, options)
    scored = vectors.withColumn("gamma", F.when(F.col("apart"), 0.0).otherwise(model.column()))
    for _ in range(options.rounds - 1):
        held = stored(_transitive(scored, options))
        model = fit(held, chance, options, "gamma", model)
        scored = held.withColumn("gamma", F.when(F.col("apart"), 0.0).otherwise(F.greatest(model.column(), F.when(F.col("gamma") >= 0.85, F.col("gamma")).otherwise(0.0))))
    return stored(scored)


def with_copies(scored: DataFrame, records: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """scored with the pairs of all records that are alike in everything, of which ``match`` has those of the first."""
    again = stored(copies(without_common(records, options)))
    of = again.union(again.select(F.col("first").alias("rid"), "first").distinct())
    last = scored.join(again.select(F.col("rid").alias("b")), "b", "left_semi")
    rest = [c for c in scored.columns if c not in ("a", "b")]
    alike = last.groupBy("a").agg(F.first(F.struct(*rest)).alias("v")).select(F.col("a").alias("first"), "v")  # they are all equal
    x, y = (of.select("first", F.col("rid").alias(n)) for n in ("a", "b"))
    within = alike.join(x, "first").join(y, "first").where("a < b").select("a", "b", "v.*")
    between = scored.join(again.select(F.col("rid").alias("b")), "b", "left_anti")
    for side in ("a", "b"):
        own = of.select(F.col("first").alias(side), F.col("rid").alias("_r"))
        between = between.join(own, side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return between.select(least, most, *rest).union(within.select("a", "b", *rest))


def works(records: DataFrame, scored: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """(rid, work): records by work, work being the least rid; records without a link are left out.

    A component that holds two kinds of work (a paper and its second part, say) is parted: each record whose
    title leaves the kind open goes with the kind to which its links are surest.
    """
    links = scored.where((F.col("gamma") >= options.sure) & ~F.col("apart")).select("a", "b", "gamma")
    found = stored(components(links, "a", "b"))
    kinds = found.join(records.select("rid", "kind"), F.col("node") == F.col("rid")).select("node", "root", "kind")
    mixed = kinds.where(~F.col("kind").endswith("?")).groupBy("root").agg(F.countDistinct("kind").alias("n")).where("n > 1").select("root")
    inside = kinds.join(mixed, "root")
    ends = inside.select(F.col("node").alias("a"), "root", F.col("kind").alias("kind_a")).join(links, "a").join(
        inside.select(F.col("node").alias("b"), F.col("kind").alias("kind_b")), "b"
    )
    sided = ends.select("root", "a", "kind_a", "kind_b", "gamma").union(ends.select("root", F.col("b"), F.col("kind_b"), F.col("kind_a"), F.col("gamma")))
    best = (
        sided.where(F.col("kind_a").endswith("?") & ~F.col("kind_b").endswith("?"))
        .groupBy(F.col("a").alias("open"), "kind_b")
        .agg(F.sum("gamma").alias("g"))
        .groupBy("open")
        .agg(F.max_by("kind_b", F.struct("g", "kind_b")).alias("to"))
    )
    parted = inside.join(best, F.col("node") == F.col("open"), "left").select("node", "root", F.coalesce("to", "kind").alias("kind"))
    given = parted.withColumn("work", F.min("node").over(Window.partitionBy("root", "kind"))).select(F.col("node").alias("rid"), "work")
    return found.join(mixed, "root", "left_anti").select(F.col("node").alias("rid"), F.col("root").alias("work")).union(given)
