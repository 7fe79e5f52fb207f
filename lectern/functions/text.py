"""Column functions over strings: keys, normal forms, tokens and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept in a normalised title beside a-z and 0-9.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"


def text(c: Column | str) -> Column:
    """A string with null as empty, as missing values are written either way."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def key(c: Column) -> Column:
    """A join key: null where empty, so that blanks never meet."""
    return F.nullif(c, F.lit(""))


def normalize_doi(c: Column | str) -> Column:
    """Trimmed, lower case, one resolver or prefix removed, closing slashes removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), r"^(https?://(dx\.)?doi\.org/|doi:\s*|info:doi/)", ""), r"/+$", "")


def normalize_title(c: Column | str) -> Column:
    """Letters a-z, digits and CJK, kana and hangul characters only, in lower case."""
    return F.regexp_replace(F.lower(text(c)), f"[^{CJK}a-z0-9]", "")


def normalize_journal(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


def paper_key(doi: Column, pmid: Column, arxiv: Column, title: Column) -> Column:
    """Identity by DOI, else PMID, else arXiv number, else normalised title; empty without any."""
    parts = ((F.lit("doi:"), normalize_doi(doi)), (F.lit("pmid:"), F.trim(text(pmid))), (F.lit("arxiv:"), F.trim(text(arxiv))), (F.lit("title:"), normalize_title(title)))
    return F.coalesce(*(F.when(v != "", F.concat(p, v)) for p, v in parts), F.lit(""))


def year_of(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"(\d{4})", 1)


def tokens(c: Column | str) -> Column:
    """Words of two characters or more in lower case, then bigrams of CJK runs (a lone character as itself)."""
    low = F.lower(text(c))
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9\-_]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), 1)
    grams = F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    )
    return F.concat(words, grams)


def split_paragraphs(c: Column | str, least: int) -> Column:
    return F.filter(F.transform(F.split(text(c), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def estimate_tokens(c: Column | str) -> Column:
    """One token per character from U+2E80 on, one per four others."""
    wide = F.length(F.regexp_replace(text(c), r"[\x{0}-\x{2e7f}]", ""))
    return (wide + F.floor((F.length(text(c)) - wide + 3) / 4)).cast("long")


def truncate_text(c: Column | str, budget: int, note: str) -> Column:
    """Head of seven tenths and tail of three tenths of twice the budget's characters, with a note between."""
    most = 2 * budget
    head, tail = most * 7 // 10, most - most * 7 // 10
    s = text(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(head)), F.lit(note), F.right(s, F.lit(tail))))


def ris_authors(c: Column | str) -> Column:
    """Authors of a comma-separated line as ``Family, G.``; lone initials get their dots, et al. goes."""
    parts = F.filter(F.transform(F.split(text(c), ","), lambda p: F.trim(p)), lambda p: (p != "") & (F.regexp_replace(F.lower(p), r"\.+$", "") != "et al"))

    def one(p: Column) -> Column:
        words = F.split(p, r"\s+")
        rest = F.slice(words, 2, 99)
        dotted = F.when(F.forall(rest, lambda t: F.length(t) == 1), F.transform(rest, lambda t: F.concat(t, F.lit(".")))).otherwise(rest)
        return F.when(F.size(words) >= 2, F.concat(F.get(words, F.lit(0)), F.lit(", "), F.array_join(dotted, " "))).otherwise(p)

    return F.transform(parts, one)


def human_size(n: Column) -> Column:
    """Bytes in units of 1024, one decimal from KB on."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    shown = lambda k, u: F.concat(F.format_string("%.1f", F.bround(n / 1024**k, 1)), F.lit(u))
    return F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B"))).when(n < 1024**2, shown(1, " KB")).when(n < 1024**3, shown(2, " MB")).otherwise(shown(3, " GB"))


def citation_key(c: Column | str) -> Column:
    """Number sequence of a citation mark whatever its brackets, null for anything else (years as well)."""
    s = F.trim(text(c))
    core = F.regexp_extract(s, r"^[\[(（〔【]?([0-9]{1,3}(?:\s*[,，;；\-–—]\s*[0-9]{1,3}){0,8})[\])）〕】]?$", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"\s", ""), "[，;；]", ","), "[–—]", "-")
    stripped = F.regexp_replace(plain, r"(^|[,\-])0+(?=\d)", "$1")
    whole = stripped.rlike(r"^\d+(-\d+)?(,\d+(-\d+)?)*$")
    return F.when((F.length(s) <= 20) & (core != "") & whole, stripped)


def version_numbers(c: Column | str) -> Column:
    """Numbers of a version padded to six, null for what is no version."""
    core = F.regexp_extract(F.trim(text(c)), r"^[vV]?\s*(\d+(?:\.\d+)*)\s*(?:[-+](.+))?$", 1)
    nums = F.transform(F.split(core, r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("int"))
    return F.when(core != "", F.slice(F.concat(nums, F.array_repeat(F.lit(0), 6)), 1, 6))


def version_suffix(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.trim(text(c)), r"^[vV]?\s*(\d+(?:\.\d+)*)\s*(?:[-+](.+))?$", 2)))


def natural_key(c: Column | str) -> Column:
    """Sort key in which runs of digits count as numbers: each is padded to twelve digits."""
    parts = F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def is_url(c: Column | str) -> Column:
    return text(c).rlike(r"^https?://\S+$")


def is_profile_name(c: Column | str) -> Column:
    """Usable as a folder on any system: no reserved characters, devices, dots at the end or blanks at the ends."""
    s = text(c)
    return (
        (s != "")
        & (F.trim(s) == s)
        & ~s.rlike(r'[\\/:*?"<>|\x00-\x1f]')
        & ~F.endswith(s, F.lit("."))
        & ~s.rlike(r"^(?i)(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$")
        & (F.length(s) <= 80)
    )


def is_safe_path(c: Column | str) -> Column:
    """Relative, without drive, stream, empty or dotted segments."""
    s = F.replace(text(c), F.lit("\\"), F.lit("/"))
    return (s != "") & F.forall(F.split(s, "/"), lambda p: ~p.isin("", ".", "..") & ~F.contains(p, F.lit(":")))


def english_share(c: Column | str) -> Column:
    """Part of a text's letters that are A-Z or a-z, 0 without letters."""
    letters = F.length(F.regexp_replace(text(c), r"[^\p{L}]", ""))
    ascii_ = F.length(F.regexp_replace(text(c), r"[^A-Za-z]", ""))
    return F.when(letters > 0, ascii_ / letters).otherwise(0.0)


def occurrences(c: Column, needle: str) -> Column:
    """Times that a string stands in another without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
