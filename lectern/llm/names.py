"""Variant spellings of the names of people and organisations.

A spelling is read into a signature: family name (or an organisation's own word), given name, initials. Family
names are compared as vectors of weighted character n-grams by a distributed sparse cosine join (rarest n-grams
first, so common ones never need to be joined), and all that are similar kept; signatures with similar family names
and given names that agree are linked, and the linked signatures are grouped by average-linkage clustering, which
keeps two people apart whom one shared initial would join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.textnorm import is_nobody, plain, unbroken, words_of
from lectern.operators.components import components
from lectern.session import stored

# Words that make a name an organisation's, and how they are cut short.
_KINDS = ("collaboration", "consortium", "initiative", "network", "study", "group", "working", "committee", "society", "association", "institute", "university", "centre", "center", "team", "investigators", "project", "program", "foundation", "council", "wg", "sg")


@dataclass(frozen=True)
class NameOptions:
    """gram: length of an n-gram. cosine: least similarity of two family names, below which only those one slip apart
    count. share: a token in more than this share of all spellings is common (so there are at most tokens per
    name / share common ones, and they fit any memory). cut: least average similarity of a cluster."""

    gram: int = 4
    cosine: float = 0.3
    share: float = 1 / 4000
    cut: float = 0.5


@dataclass
class Lexicon:
    """Common given names, and the given names that each of them may stand for."""

    given: set[str] = field(default_factory=set)
    stands_for: dict[str, set[str]] = field(default_factory=dict)
    near: dict[str, set[str]] = field(default_factory=dict)

    def prepare(self) -> None:
        """Index of the common given names by what is left of them without one letter or without their end."""
        self.near = defaultdict(set)
        for name in self.given:
            for k in range(len(name)):
                self.near[name[:k] + name[k + 1 :]].add(name)
            self.near[name].add(name)
            if len(name) > 5:
                for k in range(3, len(name) - 1):
                    self.near["^" + name[:k]].add(name)

    def is_given(self, name: str) -> int:
        """2 for a common given name, 1 for what may be a slip of one or one cut short, 0 for another name."""
        return 2 if name in self.given else int(self.canonical(name) != {name})

    def canonical(self, name: str) -> set[str]:
        """The full given names a written one may be: itself or what it is a slip of, nicknames resolved."""
        if name in self.given or name in self.stands_for:
            return self.stands_for.get(name, {name})
        # a common given name cut short, else one with a slip
        found = {x for x in self.near.get("^" + name, ())} if len(name) > 2 else set()
        if len(name) > 3 and not found:
            for key in [name, *(name[:k] + name[k + 1 :] for k in range(len(name)))]:
                found |= {x for x in self.near.get(key, ()) if slip(name, x)}
        return {full for x in found for full in self.stands_for.get(x, {x})} or {name}


def slip(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours exchanged, makes a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def _is_kind(word: str) -> bool:
    return word in _KINDS or (len(word) > 3 and any(k.startswith(word) or slip(word, k) for k in _KINDS if len(k) > 4))


def read_name(spelling: str, lexicon: Lexicon) -> tuple[str, str, str, str] | None:
    """(family, given, initials, rest) of a spelling; rest has an organisation's other words. None for nobody.

    The family name stands before a comma; without one it is the only written-out name, else the one that is
    not a common given name, else the last. An organisation's own word stands first or, if the last word is none
    of those that make organisations, last.
    """
    if is_nobody(spelling):
        return None
    words = words_of(spelling)
    if len(words) > 1 and any(_is_kind(w) for w in words):
        rest = [w for w in words if w != "the"]
        own = 0 if _is_kind(rest[-1]) or len(rest) == 1 else len(rest) - 1
        others = rest[:own] + rest[own + 1 :]
        return rest[own], "", "".join(w if w in ("wg", "sg") else w[0] for w in others), " ".join(others)
    left, comma, right = unbroken(spelling).partition(",")
    if comma and left.strip() and right.strip():
        before, after = words_of(left), right.replace(".", ". ").split()
        longs, initials = _parts(after)
        family = " ".join(before)
        if len(longs) > 0:
            return family, longs[0], longs[0][0] + "".join(x[0] for x in longs[1:]) + initials, ""
        return family, "", initials, ""
    longs, initials = _parts(unbroken(spelling).replace(",", " ").replace(".", ". ").split())
    if not longs:
        return " ".join(words), "", "", ""
    if len(longs) == 1:
        return longs[0], "", initials, ""
    if lexicon.is_given(longs[-1]) > lexicon.is_given(longs[0]):
        return " ".join(longs[:-1]) if len(longs) > 2 else longs[0], longs[-1], longs[-1][0] + initials, ""
    return longs[-1], longs[0], longs[0][0] + "".join(x[0] for x in longs[1:-1]) + initials, ""


def _parts(tokens: list[str]) -> tuple[list[str], str]:
    """Written-out names and initials among the tokens of a name."""
    longs, initials = [], ""
    for token in tokens:
        letters = plain(token).strip(".-'’ ")
        if not letters:
            continue
        if len(letters) == 1 or token.endswith(".") and len(letters) < 3 or (len(letters) <= 3 and token.isupper()):
            initials += letters
        else:
            longs.append("".join(c for c in letters if c.isalnum()))
    return [x for x in longs if x], initials


def _lexicon(spellings: DataFrame, hints: DataFrame | None, options: NameOptions) -> Lexicon:
    """Given names and nicknames, learned from how often names stand after a comma and beside one family name."""
    pair = F.split(F.lower("name"), r",\s*", 2)
    before, after = F.regexp_extract(pair[0], r"^(\p{L}{2,})$", 1), F.regexp_extract(F.get(pair, F.lit(1)), r"^(\p{L}{3,})(?: \p{L}\.?)*$", 1)
    pairs = stored(spellings.where(F.col("name").contains(",")).select(before.alias("s"), after.alias("g")).where("s <> '' and g <> ''").distinct())
    total = pairs.count()
    least = max(3, int(total * options.share))
    # at most 1 / share names reach the least count
    common = pairs.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    families = pairs.groupBy(F.col("s").alias("g")).agg(F.count("*").alias("m"))
    counts = {r.g: r.n for r in common.join(families, "g", "left").where("coalesce(m, 0) < n").collect()}
    own = stored(pairs.join(common, "g"))
    told = own.join(own.groupBy("s").agg((F.count("*") - 1).alias("others")), "s")
    # the nickname is the rarer of the two and nearly always has the full name beside it
    a, b = told.select("s", F.col("g").alias("nick"), F.col("n").alias("c")), told.select("s", F.col("g").alias("full"), F.col("n").alias("f"))
    beside = a.join(b, "s").where("f > 1.5 * c").groupBy("nick", "full", "c", "f").agg(F.count("*").alias("n"))
    likely = beside.where((F.col("n") >= 2) & (F.col("n") > 0.4 * F.col("c")) & (F.col("n") / F.col("c") > 4 * F.col("f") / max(1, total)))
    # beside a family name with very many given names any of them stands by chance (e times, with variance v), which tells nothing
    among = told.groupBy(F.col("g").alias("nick"), "others").agg(F.count("*").alias("m"))
    chance = F.least(F.lit(1.0), F.col("others") * F.col("f") / max(1, own.count()))
    weighed = likely.join(among, "nick").groupBy("nick", "full", "c", "n").agg(F.sum(F.col("m") * chance).alias("e"), F.sum(F.col("m") * chance * (1 - chance)).alias("v"))
    lexicon = Lexicon(set(counts))
    for r in weighed.where("n - e > 0.4 * (c - e) and n - e > 3 * sqrt(v)").collect():
        if r.nick in counts and r.full in counts:
            lexicon.stands_for.setdefault(r.nick, set()).add(r.full)
    if hints is not None:
        for r in hints.where("given_name is not null and nick is not null").collect():  # a fixed list
            lexicon.stands_for.setdefault(plain(r.nick), set()).add(plain(r.given_name))
    for nick in lexicon.stands_for:
        lexicon.given.add(nick)
    lexicon.prepare()
    return lexicon


def _signatures(spellings: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(name, family, canon, initials, rest, full) of each spelling; canon: the given names it may mean."""
    shared = spellings.sparkSession.sparkContext.broadcast((lexicon.given, lexicon.stands_for))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        own.prepare()
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                found = read_name(name, own)
                if found and found[0]:
                    family, given, initials, rest = found
                    canon = sorted(own.canonical(given)) if given else []
                    rows.append((name, family, canon, initials, rest, bool(given)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "family", "canon", "initials", "rest", "full"])

    return spellings.select("name").mapInArrow(of_batches, "name string, family string, canon array<string>, initials string, rest string, full boolean")


def _bag(token: str) -> Column:
    """64 bits for the letters of a token: of each of 32 classes of letters whether there is one, and whether there are two."""
    at = f"2 * (ascii(substr({token}, i, 1)) % 32)"
    return F.expr(f"aggregate(sequence(1, length({token})), 0L, (m, i) -> m | shiftleft(if((m & shiftleft(1L, {at})) = 0, 1L, 2L), {at}))")


def similar_names(tokens: DataFrame, options: NameOptions) -> DataFrame:
    """(a, b, edits, cosine): ordered pairs of different tokens whose n-gram vectors have the least cosine or more,
    and all that are one slip apart, which count as of the least cosine.

    An exact prefix filter: n-grams are ordered by frequency, and of each token only the rarest are joined
    whose omission would leave less than the cosine in what remains.
    """
    q = options.gram
    padded = F.concat(F.lit("^"), F.col("t"), F.lit("$"))
    grams = tokens.where(F.length("t") >= q - 1).select(
        "t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") + 3 - q), lambda i: F.substr(padded, i, F.lit(q))))).alias("gram")
    )
    total = tokens.count()
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    alone = grams.groupBy("t").agg(F.count("*").alias("grams"))
    lone = math.log(1 + total)
    weighted = grams.join(df, "gram").withColumn("w", F.log(1 + F.lit(float(total)) / F.col("df")))
    shared = weighted.groupBy("t").agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.count("*").alias("k"))
    norms = shared.join(alone, "t").select("t", (F.col("sq") + (F.col("grams") - F.col("k")) * lone * lone).alias("norm2"))
    unit = weighted.join(norms, "t").select("t", "gram", "df", (F.col("w") / F.sqrt("norm2")).alias("w"))
    order = Window.partitionBy("t").orderBy(F.desc("df"), "gram")
    left = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    vectors = stored(unit.withColumn("rest", left))
    prefix = vectors.where(F.col("rest") >= options.cosine**2).select("t", "gram", F.length("t").alias("size"), _bag("t").alias("bag"))
    a, b = (prefix.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("t", "size", "bag"))) for x in "ab")
    # two edits change the length by two at most, and put in and take out two letters at most
    lost = [F.bit_count(F.col(f"bag_{x}").bitwiseAND(F.bitwise_not(f"bag_{y}"))) for x, y in ("ab", "ba")]
    near = (F.abs(F.col("size_a") - F.col("size_b")) <= 2) & (lost[0] <= 2) & (lost[1] <= 2)
    pairs = a.join(b, "gram").where(near & (F.col("t_a") < F.col("t_b"))).select(F.col("t_a").alias("a"), F.col("t_b").alias("b")).distinct()
    # what can be a slip at all, before the whole vectors are joined
    distance = F.levenshtein("a", "b", 2)
    close = pairs.withColumn("edits", distance).where("edits >= 0")
    # what is one slip apart shares a form with one letter left out, and counts however few n-grams a short name keeps
    without = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.concat(F.substr("t", F.lit(1), i - 1), F.substr("t", i + 1, F.length("t"))))
    forms = tokens.where(F.length("t") >= q - 1).select("t", F.explode(F.array_distinct(F.concat(F.array("t"), without))).alias("form"))
    fa, fb = forms.select(F.col("t").alias("a"), "form"), forms.select(F.col("t").alias("b"), "form")
    exchanged = F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))
    a_slip = (F.col("edits") == 1) | ((F.col("edits") == 2) & exchanged)
    slips = stored(fa.join(fb, "form").where("a < b").select("a", "b").distinct().withColumn("edits", distance).where(a_slip))
    va, vb = vectors.select(F.col("t").alias("a"), "gram", F.col("w").alias("wa")), vectors.select(F.col("t").alias("b"), "gram", F.col("w").alias("wb"))
    products = close.union(slips).distinct().join(va, "a").join(vb, ["b", "gram"]).select("a", "b", "edits", (F.col("wa") * F.col("wb")).alias("cosine"))
    scored = products.union(slips.withColumn("cosine", F.lit(0.0))).groupBy("a", "b", "edits").agg(F.sum("cosine").alias("cosine"))
    scored = stored(scored.where((F.col("cosine") >= options.cosine) | a_slip).withColumn("cosine", F.greatest("cosine", F.lit(options.cosine))))  # read in both orders
    return scored.union(scored.select(F.col("b"), F.col("a"), F.col("edits"), F.col("cosine")))


def _agree(x: str, y: str) -> Column:
    """0..1: whether what stands beside two family names may belong to one person or organisation."""
    c = lambda f, s: F.col(f"{f}_{s}")
    first = F.substr(c("initials", x), F.lit(1), F.lit(1)) == F.substr(c("initials", y), F.lit(1), F.lit(1))
    second = [F.substr(c("initials", s), F.lit(2)) for s in (x, y)]
    middle = (second[0] == "") | (second[1] == "") | second[0].startswith(second[1]) | second[1].startswith(second[0])
    full = c("full", x) & c("full", y)
    stands = lambda s, o: F.exists(c("canon", s), lambda g: F.substr(g, F.lit(1), F.lit(1)) == F.substr(c("initials", o), F.lit(1), F.lit(1)))
    one_initial = F.when(c("full", x), stands(x, y) | first).when(c("full", y), stands(y, x) | first).otherwise(first)
    person = F.when(~middle, 0.0).when(full, F.when(F.arrays_overlap(c("canon", x), c("canon", y)), 1.0).otherwise(0.0)).otherwise(F.when(one_initial, 0.85).otherwise(0.0))
    org = [c("rest", s) != "" for s in (x, y)]
    words = [F.split(c("rest", s), " ") for s in (x, y)]
    fits = lambda u, v: F.forall(u, lambda w: F.exists(v, lambda z: z.startswith(w) | w.startswith(z) | (F.levenshtein(z, w) <= 2)))
    whole = F.when(fits(words[0], words[1]) | fits(words[1], words[0]), 1.0).when(c("initials", x) == c("initials", y), F.when(c("rest", x).rlike(r"\b(wg|sg)\b") | c("rest", y).rlike(r"\b(wg|sg)\b"), 0.9).otherwise(0.0)).otherwise(0.0)
    short = F.when(~c("full", x) & ~c("full", y) & (c("initials", x) == c("initials", y)) & (F.length(c("initials", x)) > 1), 0.85).otherwise(0.0)
    return F.when(org[0] & org[1], whole).when(org[0] | org[1], short).otherwise(person)


def _linkage(rows: list[tuple[int, int, float]], weight: dict[int, int], cut: float) -> dict[int, int]:
    """Average-linkage clusters of nodes given as links (a, b, similarity); what isn't linked is at 0."""
    size = {n: 1 for n in weight}
    mass = dict(weight)
    members = {n: [n] for n in weight}
    link: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, s in rows:
        link[a][b] = link[b][a] = max(s, link[a].get(b, 0.0))
    while True:
        best = None
        for a in link:
            for b, s in link[a].items():
                if a < b:
                    average = s / (size[a] * size[b])
                    key = (round(average, 6), mass[a] + mass[b], -a, -b)
                    if average >= cut and (best is None or key > best[0]):
                        best = (key, a, b)
        if best is None:
            break
        _, a, b = best
        for other, s in link.pop(b).items():
            del link[other][b]
            if other != a:
                link[a][other] = link[other][a] = link[a].get(other, 0.0) + s
        size[a] += size.pop(b)
        mass[a] += mass.pop(b)
        members[a] += members.pop(b)
    return {n: min(own) for own in members.values() for n in own}


def name_groups(spellings: DataFrame, hints: DataFrame | None = None, options: NameOptions = NameOptions()) -> DataFrame:
    """(name, entity): of every spelling in ``spellings`` (name) the number of the person or organisation.

    Null and blank spellings and stand-ins for absent authors are left out; repeated spellings count once. An
    initial that several people share goes with the one to whose spellings it is closest on average, the more
    frequent one in a tie.
    """
    distinct = stored(spellings.select(F.trim("name").alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")))
    lexicon = _lexicon(distinct, hints, options)
    read = stored(
        _signatures(distinct, lexicon)
        .join(distinct, "name")
        .withColumn("node", F.xxhash64("family", F.array_join("canon", "|"), "initials", "rest"))
    )
    nodes = stored(
        read.groupBy("node").agg(
            F.first("family").alias("family"), F.first("canon").alias("canon"), F.first("initials").alias("initials"), F.first("rest").alias("rest"), F.first("full").alias("full"), F.sum("n").alias("n")
        )
    )
    families = nodes.groupBy(F.col("family").alias("t")).agg(F.sum("n").alias("n"))
    near = similar_names(families.select("t"), options)
    counted = near.join(families.select(F.col("t").alias("a"), F.col("n").alias("na")), "a").join(families.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b")
    # a slip is rarer than what it is a slip of; two edits are one only in a long name or as an exchange of neighbours
    exchanged = F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))
    ratio = F.greatest("na", "nb") / F.least("na", "nb")
    slips = counted.where((ratio >= 2) & ((F.col("edits") == 1) | exchanged | ((F.length("a") >= 8) & (ratio >= 3))))
    alike = slips.select("a", "b", (0.55 + 0.45 * F.col("cosine")).alias("alike"), (ratio >= 4).alias("clear")).union(
        families.select("t", "t", F.lit(1.0), F.lit(True))
    )
    # keys under which signatures of similar families meet: each given name meant, and the first letter for initials
    letters = F.array_distinct(F.concat(F.array(F.substr("initials", F.lit(1), F.lit(1))), F.transform("canon", lambda g: F.substr(g, F.lit(1), F.lit(1)))))
    written = nodes.select("node", "family", F.explode(F.when(F.col("full"), F.col("canon")).otherwise(F.array(F.lit("*")))).alias("k"), "full")
    initial = nodes.select("node", "family", F.explode(F.when(F.col("initials") == "", F.array(F.lit("?"))).otherwise(letters)).alias("k"), "full")
    one, two = (lambda t, s: t.select(*(F.col(c).alias(f"{c}_{s}") for c in t.columns))), F.col
    met = []
    initial_only = initial.where("not full")  # an initial beside a slip is little evidence: the slip must be clear
    for left, right in ((written.where("full"), written.where("full")), (initial_only, initial)):
        joined = one(left, "a").join(alike if left is not initial_only else alike.where("clear"), two("family_a") == two("a")).join(one(right, "b"), (two("family_b") == two("b")) & (two("k_a") == two("k_b")))
        met.append(joined.where("node_a <> node_b").select("node_a", "node_b", "alike"))
    pairs = met[0].union(met[1]).select(F.least("node_a", "node_b").alias("x"), F.greatest("node_a", "node_b").alias("y"), "alike").groupBy("x", "y").agg(F.max("alike").alias("alike"))
    sides = [nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in nodes.columns)) for s in "ab"]
    linked = pairs.join(sides[0], F.col("x") == F.col("node_a")).join(sides[1], F.col("y") == F.col("node_b"))
    links = stored(linked.select("x", "y", (F.col("alike") * _agree("a", "b")).alias("s")).where(F.col("s") >= options.cut))
    found = stored(components(links, "x", "y"))
    sizes = found.groupBy("root").agg(F.count("*").alias("nodes"))
    inside = links.join(found, F.col("x") == F.col("node")).select("root", "x", "y", "s")
    degrees = inside.groupBy("root").agg(F.count("*").alias("links")).join(sizes, "root")
    # where every two signatures are linked there is nothing to part
    open_ = degrees.where(F.col("links") < F.col("nodes") * (F.col("nodes") - 1) / 2).select("root")
    weights = nodes.select("node", "n")
    work = (
        inside.join(open_, "root")
        .join(weights.select(F.col("node").alias("x"), F.col("n").alias("nx")), "x")
        .join(weights.select(F.col("node").alias("y"), F.col("n").alias("ny")), "y")
        .select("root", "x", "y", "s", "nx", "ny")
    )

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, float]] = []
        weight: dict[int, int] = {}
        current, out = None, []
        for batch in batches:
            for root, x, y, s, nx, ny in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if root != current:
                    out += _linkage(rows, weight, options.cut).items()
                    rows, weight, current = [], {}, root
                rows.append((x, y, s))
                weight[x], weight[y] = nx, ny
        out += _linkage(rows, weight, options.cut).items()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], ["node", "entity"])

    parted = work.repartition("root").sortWithinPartitions("root").mapInArrow(cluster, "node long, entity long")
    whole = found.join(open_, "root", "left_anti").select("node", F.col("root").alias("entity"))
    entity = parted.union(whole)
    return read.join(entity, "node", "left").select("name", F.coalesce("entity", "node").alias("entity"))
