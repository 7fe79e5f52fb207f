"""Noise in text from scanned pages: what belongs to the page and not to the paper, torn and misread words.

Misread words are found by anagram hashes: a word's hash is the sum of the fifth powers of its letters, so every
confusion of letters is one difference of hashes, and rare words meet the frequent words they may stand for in a
plain equality join. Torn words are judged by how often the halves are found joined, with a hyphen, or alone.
Running heads and the like are lines at the edges of pages that return within a document, or whose form is found
at edges only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.components import components
from lectern.session import stored

# What a recogniser reads (first) for what is printed (second). Those with a sign or digit, then letters.
_SIGNS = {"0": "o", "1": "li", "2": "z", "3": "e", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "€": "e", "(": "c", "!": "il", "|": "l", "$": "s"}
_LETTERS = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("i", "l"), ("l", "i"), ("j", "i"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"), ("q", "g"), ("g", "q"), ("a", "o"), ("o", "a"), ("v", "y"), ("y", "v"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("nn", "m"), ("in", "m"), ("m", "in"), ("iii", "m"),
)
#: Marks at which a word is broken.
_MARKS = "-‐\xad¬"


@dataclass(frozen=True)
class ScanOptions:
    """share: a word with at least this share of all words (and ``least`` occurrences) is frequent, so there are at
    most 1 / share frequent words and they fit any memory. ratio: times that a frequent word must outnumber a
    rare one that may be a misreading of it. own: a word with this share of all words is one by itself (with ten
    occurrences, below which its share isn't known), so it must be outnumbered by often times. edge: least part of a line's or form's occurrences at edges."""

    share: float = 2e-6
    least: int = 4
    ratio: float = 8.0
    often: float = 60.0
    own: float = 1e-4
    edge: float = 0.9


_WORD = re.compile(r"[a-zà-öø-ÿ]+(?:-[a-zà-öø-ÿ]+)*")
_SOFT = re.compile(r"(?<=[a-zà-öø-ÿ])[‐\xad¬]\s*(?=[a-zà-öø-ÿ])|(?<=[a-zà-öø-ÿ])-\s+(?=[a-zà-öø-ÿ])")
_TORN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*)(-\s+|[‐\xad¬]\s*)([a-zà-öø-ÿ]+)")
_END = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-‐\xad¬])\s*$")
_FIRST = re.compile(r"\s*([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_SIGNED = re.compile(r"(?<![\w/.:@#&])[A-Za-z]*[a-z][0-9@€!|$(][A-Za-z0-9@€!|$(]*(?![\w/@]|\.\w)|(?<![\w/.:@#&])[0-9@€!|$][a-z0-9@€!|$(]*[a-z]{2}[a-z0-9@€!|$(]*(?![\w/@]|\.\w)")
_NUMBER = re.compile(r"^[\[(–—\-\s]*(?:p\.?|page|pp\.?)?\s*((?=[lIO]*\d)[\dlIO]{1,5})\s*(?:(?:of|/)\s*[\dlIO]+)?[\])–—\-\s]*$", re.I)
_DIGITS = str.maketrans("lIO", "110")
_TOKEN = re.compile(r"[^\W\d_]+|#|[^\w\s]|_")
_LINKING = frozenset("of and et al on in for the with a".split())
_CAPTION = re.compile(r"^\s*(?:figure|fig\.|table|scheme|equation)\s*\w{1,4}\s*[.:]", re.I)
_CLOSED = frozenset(".!?:;。！？：；…")
# lines within a text that have the form of a running head: number beside a name, all capitals, volume, year, et al.
_HEAD_LINE = re.compile(
    r"^\s*(?:\d{1,5}\s{1,4}(?:[|•]\s*)?)?(?:[A-ZÀ-Ö][^.]{6,90},\s*Vol\.\s*\d+|[A-Z][\w\-’' ]{6,80}\((?:19|20)\d\d\)|[A-Z][\w\-’']+\s+et al\.|[A-ZÀ-Ö][A-ZÀ-Öa-z\-’' ]{3,40}\bAND C[A-Za-z]{6,12}\b.*|[A-Z][\w\-’']+\s*•\s*\d+|[A-Z0-9À-Ö][A-ZÀ-Ö0-9 ,:\-–—’'&?]{14,110})(?:\s{2,}\d{1,5}|\s*[|•]\s*\d{1,5})?\s*$"
)


_BREAK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?:-\s+|[‐\xad¬]\s*)(?=[a-zà-öø-ÿ])")
_LEFT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*$")
_RIGHT = re.compile(r"[a-zà-öø-ÿ]+")
_NEAR_SIGN = re.compile(r"[a-z][0-9@€!|$(]|[0-9@€!|$][a-z]{2}")
_LOWER = re.compile(r"\b[a-zà-öø-ÿ]{2,}\b")
_CJK = re.compile(r"[぀-鿿]")


def _may_be_head(line: str) -> bool:
    """A cheap test that every line of a running head's form passes."""
    return len(line) < 130 and (line.isupper() or " et al" in line or "Vol." in line or "•" in line or " AND C" in line or "|" in line or line.rstrip("0123456789 ").endswith(")"))


def form_of(text: str) -> str:
    """A line's form: C for capitals, W for a capitalised word, w for others, # for a number, runs as one."""
    out: list[str] = []
    for w in _TOKEN.findall(re.sub(r"\d+", "#", text.strip())):
        if w[0].isalpha():
            kind = "C" if w.isupper() and len(w) > 1 else "W" if w[0].isupper() else w if w in _LINKING else "w"
            if out and out[-1] == kind and kind in "CWw":
                continue
            out.append(kind)
        else:
            out.append(w)
    return " ".join(out)


def _head_key(text: str) -> str:
    """What the variants of one running head share: its letters without page number, as many as a cut one has."""
    return re.sub(r"[^a-zà-öø-ÿ]", "", text.lower())[:14]


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, hash) over all texts; words are in lower case, with the hyphens inside them."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    low = text.lower()
                    counts.update(_WORD.findall(_SOFT.sub("", low) if "-" in low or "\xad" in low or "¬" in low or "‐" in low else low))
            if len(counts) > 500_000:
                yield of(counts)
                counts = Counter()
        yield of(counts)

    def of(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) < 50]
        hashes = [sum(ord(c) ** 5 for c in w) for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array(hashes, pa.int64())], ["word", "n", "hash"])

    partial = texts.mapInArrow(of_partition, "word string, n long, hash long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))


def misread_words(vocabulary: DataFrame, options: ScanOptions) -> DataFrame:
    """(word, meant, n): rare words and the frequent word each is most likely a misreading of, by anagram hash."""
    rules = [(a, b) for a, b in _LETTERS]
    value = lambda s: sum(ord(c) ** 5 for c in s)
    table = F.array(*(F.struct(F.lit(a).alias("read"), F.lit(b).alias("meant"), F.lit(value(b) - value(a)).alias("d")) for a, b in rules))
    words = vocabulary.where((F.length("word") >= 3) & ~F.contains("word", F.lit("-")))
    frequent = words.where(F.col("n") >= options.least).select(F.col("word").alias("to"), F.col("n").alias("to_n"), F.col("hash").alias("key"))
    tried = words.select("word", "n", "hash", F.explode(F.filter(table, lambda r: F.contains(F.col("word"), r["read"]))).alias("r")).select(
        "word", "n", "r.read", "r.meant", (F.col("hash") + F.col("r.d")).alias("key")
    )
    own = max(10.0, options.own * (vocabulary.agg(F.sum("n")).first()[0] or 0))
    met = tried.join(frequent, "key").where((F.col("to_n") >= F.when(F.col("n") < own, options.ratio * F.col("n")).when(F.length("word") < 5, 3 * options.often * F.col("n")).otherwise(options.often * F.col("n"))) & (F.length("to") == F.length("word") - F.length("read") + F.length("meant")))
    # equal hashes are anagrams at best: the confusion must stand at one place
    at = F.exists(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: (F.substr("word", i, F.length("read")) == F.col("read"))
        & (F.concat(F.substr("word", F.lit(1), i - 1), F.col("meant"), F.substr("word", i + F.length("read"), F.length("word"))) == F.col("to")),
    )
    return met.where(at).groupBy("word").agg(F.max_by("to", F.struct("to_n", "to")).alias("meant"), F.max("n").alias("n"))


def _read_signs(token: str, known: dict[str, int]) -> str | None:
    """The word that a token with signs or digits among its letters stands for, if it is one."""
    low = token.lower()
    letters = sum(c.isalpha() for c in low)
    if letters < 2 or letters < 2 * (len(low) - letters):
        return None
    options = [""]
    for c in low:
        options = [o + x for o in options for x in (_SIGNS.get(c, c) if not c.isalpha() else c)][:16]
    best = max((o for o in options if o.isalpha()), key=lambda o: known.get(o, 0), default=None)
    if best is None:
        return None
    if known.get(best):
        return best
    # a word too rare to be known: signs between letters of a long word are no part of any spelling
    return best if letters >= 6 and re.fullmatch(r"[a-z]+(?:[0-9@€!|$][a-z]+)+", low) else None


def _torn(a: str, mark: str, b: str, known: dict[str, int]) -> bool:
    """Whether the mark between two parts tears a word rather than being its hyphen."""
    a, b = a.lower(), b.lower()
    last = a.rpartition("-")[2]
    joined = known.get(a + b, 0) or known.get(last + b, 0)
    spelt = known.get(f"{a}-{b}", 0) or known.get(f"{last}-{b}", 0)
    if joined or spelt:
        return joined > spelt
    return mark != "-" or not (known.get(last) and known.get(b) and len(last) > 2 and len(b) > 2)


_FEATURES = (
    "elem_pk long, doc_key string, page int, n int, type string, short string, norm string, form string, number int, running boolean, open_end boolean, "
    "frag string, mark string, first string, torn boolean, signed boolean, rare string, heads string"
)


def _features(elements: DataFrame, known: dict[str, int]) -> DataFrame:
    """One light row per element with everything that its own text tells."""
    shared = elements.sparkSession.sparkContext.broadcast(known)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = [_row(*values, words) for values in zip(*(batch.column(k).to_pylist() for k in range(6)))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = [part.split()[0] for part in _FEATURES.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [arrow[part.split()[1]] for part in _FEATURES.split(", ")]
    order = F.regexp_extract("element_id", r"_e(\d+)$", 1)
    rows = elements.select("elem_pk", "doc_key", "page", F.coalesce(F.nullif(order, F.lit("")).cast("int"), F.lit(0)).alias("n"), "element_type", "text")
    return rows.mapInArrow(of_batches, _FEATURES)


def _row(pk, doc, page, n, kind, text, known: dict[str, int]) -> tuple:
    text = text or ""
    bare = text.strip()
    short = norm = form = number = None
    if bare and len(bare) <= 120 and "\n" not in bare:
        short, norm, form = bare, re.sub(r"\d+", "#", bare.lower()), form_of(bare)
        found = _NUMBER.match(bare)
        number = int(found.group(1).translate(_DIGITS)) if found else None
    torn, whole = False, text
    if ("-" in text or not text.isascii()) and _BREAK.search(text):
        for m in _BREAK.finditer(text):
            left, right = _LEFT.search(text[max(0, m.start() - 60) : m.start()]), _RIGHT.match(text, m.end())
            if left and right and _torn(left[0], m[0][0], right[0], known):
                torn = True
                break
        whole = _SOFT.sub("", text)
    signed = bool(_NEAR_SIGN.search(whole)) and any(_read_signs(m[0], known) for m in _SIGNED.finditer(whole))
    rare = {p for w in set(_WORD.findall(whole.lower())).difference(known) if len(w) > 2 for p in (w.split("-") if "-" in w else (w,)) if p not in known and 2 < len(p) < 40}
    tail = text[-60:].rstrip()
    end = _END.search(tail) if tail[-1:] and tail[-1] in _MARKS else None
    first = _FIRST.match(text)
    if len(bare) > 200:
        running = True
    else:
        words = len(_LOWER.findall(bare))
        cjk = 0 if bare.isascii() else len(_CJK.findall(bare[:60]))
        running = bool(bare) and (words >= 2 or cjk >= 6 or (words >= 1 and bare[0].islower()) or (bare[-1] in ".。" and words >= 1)) and not _CAPTION.match(bare)
    heads = [_head_key(line) for line in text.split("\n") if _may_be_head(line) and _HEAD_LINE.match(line)] if "\n" in bare else []
    return (
        pk, doc, page, n, kind, short, norm, form, number, running, bool(bare) and bare[-1] not in _CLOSED,
        end[1] if end else None, end[2] if end else None, first[1] if first else None, torn, signed, "|".join(sorted(rare)), "|".join(h for h in heads if h),
    )


_FIXED_TYPES = ("title", "authors", "abstract_heading", "reference")


def _furniture(light: DataFrame, options: ScanOptions) -> DataFrame:
    """light with ``furniture``."""
    page = Window.partitionBy("doc_key", "page")
    # only short lines are looked at, but every element counts for the ranks
    places = light.select("elem_pk", "doc_key", "page", "n", "type", "short", "norm", "form", "number")
    # dense ranks, so that repeated rows share theirs
    ranked = places.withColumn("from_top", F.dense_rank().over(page.orderBy("n", "elem_pk"))).withColumn("from_end", F.max("from_top").over(page) - F.col("from_top") + 1)
    at_edge = (F.col("from_top") == 1) | (F.col("from_end") == 1)
    near = (F.col("from_top") <= 2) | (F.col("from_end") <= 2)
    lines = stored(ranked.where(F.col("short").isNotNull() & ~F.coalesce("type", F.lit("")).isin(*_FIXED_TYPES)).withColumn("edge", at_edge).withColumn("near", near).distinct())
    # a line counts as at the edge when nothing but another such line lies beyond it
    per_doc = lines.groupBy("norm", "doc_key").agg(F.count("*").alias("c"), F.countDistinct("page").alias("pages"), F.sum(F.col("edge").cast("int")).alias("e"))
    per_line = per_doc.groupBy("norm").agg(F.count("*").alias("docs"), F.sum("c").alias("all"), F.sum("e").alias("edges"))
    per_form = lines.groupBy("form").agg(F.count("*").alias("f_all"), F.sum(F.col("edge").cast("int")).alias("f_edges"))
    offsets = lines.where(F.col("number").isNotNull()).groupBy("doc_key", (F.col("number") - F.col("page")).alias("off")).agg(F.count("*").alias("off_n"))
    joined = (
        lines.join(per_doc.select("norm", "doc_key", "pages"), ["norm", "doc_key"])
        .join(per_line, "norm")
        .join(per_form, "form")
        .withColumn("off", F.col("number") - F.col("page"))
        .join(offsets, ["doc_key", "off"], "left")
    )
    plain_number = F.col("short").rlike(r"^\d+$")
    counted = F.coalesce((F.col("off_n") >= 2) | (F.col("off") == 0), F.lit(False))
    figure = F.coalesce("type", F.lit("")).isin("equation", "table")
    number = F.col("number").isNotNull() & F.when(plain_number, counted & near & ~figure | (F.col("from_end") <= 2) & ~figure).otherwise(near)
    edge_line = F.col("edges") >= options.edge * F.col("all")
    returns = F.col("edge") & edge_line & (F.col("pages") >= 2)
    stamp = F.col("edge") & edge_line & (F.col("docs") >= 3) & (F.col("all") >= 1.5 * F.col("docs"))
    bare_form = ~F.col("form").rlike(r"(^| )w( |$)") | F.col("form").rlike(r"^(# )?(C )+·")
    by_form = F.col("edge") & (F.col("f_edges") >= 0.95 * F.col("f_all")) & (F.col("f_all") >= 10) & bare_form & (F.length("form") > 1)
    letters = F.regexp_replace("short", r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    shouted = F.col("edge") & (F.length(letters) >= 14) & (capitals >= 0.8 * F.length(letters))
    named = F.col("edge") & F.col("short").rlike(
        r"^(?i)doi:\s*10\.\d|^\d*\s*[\p{L}\-’']+ et al\.?\s*\d*$|, Vol\. ?\d+\s*\d*$|^\d*\s*\p{Lu}[\p{L} \-’']+ \((19|20)\d\d\)\s*\d*$|\bAND COLL"
    ) | near & F.col("short").rlike(r"^[\dlIO]+\s*\|\s*\p{Lu}|^\p{Lu}[\p{L}\-’']+\s*•\s*[\dlIO]+$")
    judged = stored(joined.withColumn("is", number | returns | stamp | by_form | shouted | named).select("elem_pk", "doc_key", "norm", "near", "is"))
    # what is left at an edge and differs by a slip or two from such a line of its document
    marks = lambda df, c: df.select(c, "doc_key", F.explode(F.array(F.concat(F.lit("^"), F.substr("norm", F.lit(1), F.lit(4))), F.concat(F.lit("$"), F.substr("norm", F.greatest(F.lit(1), F.length("norm") - 3))))).alias("mark"))
    sure = judged.where("is").select(F.col("norm"), "doc_key").distinct().where(F.length("norm") >= 8).withColumn("line", F.col("norm"))
    open_ = judged.where(F.col("near") & ~F.col("is") & (F.length("norm") >= 8))
    slips = marks(open_.withColumn("pair", F.struct("elem_pk", "norm")), "pair").join(marks(sure, "line"), ["doc_key", "mark"]).where(F.levenshtein(F.col("pair.norm"), F.col("line"), 3) >= 0)
    found = judged.where("is").select("elem_pk").union(slips.select("pair.elem_pk")).distinct().withColumn("furniture", F.lit(True))
    return light.join(found, "elem_pk", "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))


@dataclass
class ScanNoise:
    """light: the elements' features with ``furniture``; misread: (elem_pk, word, meant); torn_ends: (elem_pk);
    embedded: (elem_pk); continues: (elem_pk, next_pk); known: the frequent words."""

    light: DataFrame
    misread: DataFrame
    torn_ends: DataFrame
    embedded: DataFrame
    continues: DataFrame
    known: dict[str, int]


def find_noise(elements: DataFrame, options: ScanOptions = ScanOptions()) -> ScanNoise:
    """What disturbs the texts of page elements (elem_pk, doc_key, page, element_id, element_type, text).

    Repeated rows count once; null and empty texts have no defects and are never paragraphs; rows without a page
    or document are judged by their own text alone.
    """
    vocabulary = stored(_word_counts(elements.where("text <> ''").select("text")))
    pairs = stored(misread_words(vocabulary, options))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    least = max(options.least, int(total * options.share))
    # at most 1 / share words
    trusted = vocabulary.where(F.col("n") >= least).join(pairs.select("word"), "word", "left_anti")
    known = {r.word: r.n for r in trusted.select("word", "n").collect()}
    light = stored(_furniture(stored(_features(elements, known)), options))
    rest = light.where(~F.col("furniture"))
    misread = (
        rest.where("rare <> ''").select("elem_pk", F.explode(F.split("rare", r"\|")).alias("word")).join(pairs.select("word", "meant"), "word").select("elem_pk", "word", "meant").distinct()
    )
    heads = rest.where("heads <> ''").select("elem_pk", "doc_key", F.explode(F.split("heads", r"\|")).alias("head"))
    embedded = heads.select("elem_pk").distinct()
    float_like = F.coalesce("type", F.lit("")).isin("equation", "table", "figure_caption", "reference", "title", "authors", "abstract_heading") & (F.length(F.coalesce("short", F.lit("-" * 121))) <= 120)
    body = rest.where(F.col("page").isNotNull() & F.col("doc_key").isNotNull() & F.col("running") & ~float_like & ~F.coalesce("type", F.lit("")).isin("reference", "figure_caption", "title", "authors"))
    ends = body.groupBy("doc_key", "page").agg(
        F.max_by(F.struct("elem_pk", "open_end", "frag", "mark"), F.struct("n", "elem_pk")).alias("last"),
        F.min_by(F.struct("elem_pk", "first"), F.struct("n", "elem_pk")).alias("head"),
    )
    following = ends.select("doc_key", (F.col("page") - 1).alias("page"), F.col("head.elem_pk").alias("next_pk"), F.col("head.first").alias("next_word"))
    seams = stored(
        ends.join(following, ["doc_key", "page"]).where("last.open_end").select(F.col("last.elem_pk").alias("elem_pk"), "next_pk", F.col("last.frag").alias("frag"), F.col("last.mark").alias("mark"), "next_word")
    )
    # an element that ends in a mark within its page goes on in the next one there
    order = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk")
    after = Window.partitionBy("doc_key", "page").orderBy("r").rangeBetween(1, 1)  # repeated rows have one rank
    within = body.withColumn("r", F.dense_rank().over(order)).withColumn("next_word", F.first("first").over(after)).where("frag is not null and next_word is not null").select("elem_pk", "frag", "mark", "next_word")
    torn = _torn_ends(seams.where("frag is not null and next_word is not null").select("elem_pk", "frag", "mark", "next_word").union(within), vocabulary)
    return ScanNoise(light, misread, torn, embedded, seams.select("elem_pk", "next_pk"), known)


def _torn_ends(ends: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(elem_pk) of the ends whose mark tears a word that goes on in the next element."""
    low = ends.select("elem_pk", "mark", F.lower("frag").alias("a"), F.lower("next_word").alias("b")).withColumn("joined", F.concat("a", "b")).withColumn("spelt", F.concat_ws("-", "a", "b"))
    for name in ("joined", "spelt", "a", "b"):
        low = low.join(vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
    n = {name: F.coalesce(f"n_{name}", F.lit(0)) for name in ("joined", "spelt", "a", "b")}
    known = (n["joined"] > 0) | (n["spelt"] > 0)
    alone = (F.col("mark") != "-") | ~((n["a"] > 3) & (n["b"] > 3) & (F.length("a") > 2) & (F.length("b") > 2))
    return low.where(F.when(known, n["joined"] > n["spelt"]).otherwise(alone)).select("elem_pk").distinct()


def defects(noise: ScanNoise) -> DataFrame:
    """(elem_pk, defect): furniture, and of other elements embedded, hyphen, misread and continues."""
    light = noise.light
    rest = light.where(~F.col("furniture"))
    as_ = lambda df, name: df.select("elem_pk", F.lit(name).alias("defect"))
    hyphen = rest.where("torn").select("elem_pk").union(noise.torn_ends)
    misread = rest.where("signed").select("elem_pk").union(noise.misread.select("elem_pk"))
    return (
        as_(light.where("furniture"), "furniture")
        .union(as_(noise.embedded, "embedded"))
        .union(as_(hyphen, "hyphen"))
        .union(as_(misread, "misread"))
        .union(as_(noise.continues, "continues"))
        .distinct()
    )


def paragraphs(elements: DataFrame, noise: ScanNoise) -> DataFrame:
    """(doc_key, page, n, first_pk, n_elements, text): the clean paragraphs, those across pages joined.

    Furniture and embedded lines are left out, torn words joined, misread words corrected, line ends made
    blanks. A paragraph stands where its first element does.
    """
    known = elements.sparkSession.sparkContext.broadcast(noise.known)
    fixes = noise.misread.groupBy("elem_pk").agg(F.concat_ws("|", F.collect_set(F.concat_ws("=", "word", "meant"))).alias("fixes"))  # a text's own words
    torn = noise.torn_ends.withColumn("torn_end", F.lit(True))
    kept = noise.light.where(~F.col("furniture") & (F.coalesce("type", F.lit("")) != "equation")).select("elem_pk", "page", "n").join(fixes, "elem_pk", "left").join(torn, "elem_pk", "left")
    texts = elements.where("text <> ''").select("elem_pk", "doc_key", "text").distinct().join(kept.distinct(), "elem_pk")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            out = [_clean(t, f, e, words) for t, f, e in zip(*(batch.column(c).to_pylist() for c in ("text", "fixes", "torn_end")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("elem_pk", "doc_key", "page", "n")), pa.array(out, pa.string())], ["elem_pk", "doc_key", "page", "n", "text"])

    cleaned = texts.mapInArrow(clean, "elem_pk long, doc_key string, page int, n int, text string")
    chains = components(noise.continues, "elem_pk", "next_pk")
    numbered = cleaned.join(chains.select(F.col("node").alias("elem_pk"), "root"), "elem_pk", "left").withColumn("root", F.coalesce("root", "elem_pk"))
    parts = numbered.groupBy("doc_key", "root").agg(F.array_sort(F.collect_list(F.struct("page", "n", "elem_pk", "text"))).alias("p"))  # the elements of one paragraph
    # a torn word at an element's end was left with a mark that can't be typed, to be joined here
    text = F.regexp_replace(F.concat_ws(" ", F.transform("p", lambda x: x["text"])), " ?", "")
    first = F.get("p", F.lit(0))
    return parts.select("doc_key", first["page"].alias("page"), first["n"].alias("n"), first["elem_pk"].alias("first_pk"), F.size("p").alias("n_elements"), text.alias("text"))


def _clean(text: str, fixes: str | None, torn_end: bool | None, known: dict[str, int]) -> str:
    if "\n" in text:
        text = "\n".join(line for line in text.split("\n") if not (_may_be_head(line) and _HEAD_LINE.match(line)))
    text = _TORN.sub(lambda m: m[1] + m[3] if _torn(m[1], m[2][0], m[3], known) else m[1] + "-" + m[3], text)
    text = _SIGNED.sub(lambda m: _as_written(m[0], _read_signs(m[0], known) or m[0]), text)
    for fix in (fixes or "").split("|"):
        if fix:
            wrong, _, right = fix.partition("=")
            text = re.sub(rf"\b{re.escape(wrong)}\b", lambda m, r=right: _as_written(m[0], r), text, flags=re.I)
    text = " ".join(text.split())
    return _END.sub(lambda m: m[1] + "", text) if torn_end else text


def _as_written(old: str, new: str) -> str:
    return new[:1].upper() + new[1:] if old[:1].isupper() else new
