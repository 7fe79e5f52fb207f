"""Normal forms of titles, identifiers, names and abstracts as people and services write them."""

from __future__ import annotations

import re
import unicodedata

import xxhash

_MOJIBAKE = re.compile("[ÂÃÅâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
_ENTITY = re.compile(r"&(amp|lt|gt|quot|#\d+);")
_NOT_WORD = re.compile(r"[^0-9a-zЀ-ӿ぀-ヿ㐀-鿿가-힯]+")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_PREPRINT = re.compile(r"(\d{4}\.\d{4,5})(?:v\d+)?$")
_DIGITS = re.compile(r"\d{5,}")
_YEAR = re.compile(r"(?:19|20)\d\d")
# Letters that decomposition leaves as they are.
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "Ø": "O", "Ł": "L", "Đ": "D", "Æ": "AE", "Œ": "OE"})


def unbroken(text: str) -> str:
    """Text whose UTF-8 was read as a one-byte code page, put right where that is possible."""
    if _MOJIBAKE.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                return text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
    return text


def plain(text: str | None) -> str:
    """Lower case without marks on letters."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unbroken(text).translate(_LETTERS))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def number(text: str) -> int:
    """A 63-bit number of a text, the same in every process."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def doi_of(raw: str | None) -> str:
    """The DOI proper, lower case, without resolver, prefix, blanks or closing slashes; empty if there is none."""
    found = _DOI.search(raw.lower()) if raw else None
    return found.group(0).rstrip("/.,;") if found else ""


def preprint_of(raw: str | None) -> str:
    """A preprint number without its version, from the number itself or the DOI made of it."""
    found = _PREPRINT.search((raw or "").strip().lower())
    return found.group(1) if found else ""


def digits_of(raw: str | None) -> str:
    found = _DIGITS.search(raw or "")
    return found.group(0) if found else ""


def year_of(raw: str | None) -> int | None:
    found = _YEAR.search(raw or "")
    return int(found.group(0)) if found else None


def words_of(text: str | None) -> list[str]:
    """Words of a title or a line of names without tags, entities, marks and punctuation."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _ENTITY.sub(" ", _TAG.sub("", text))
    return _NOT_WORD.sub(" ", plain(text)).split()


_NUMERAL = re.compile(r"(?:part|series|teil|no|volume)$")
_ROMAN = re.compile(r"[ivx]{1,4}$")
_ORDINAL = re.compile(r"\d(?:st|nd|rd|th)$")


def _near(word: str, model: str) -> bool:
    """Whether a word is a model word with at most one wrong, missing, additional or exchanged letter."""
    if word == model:
        return True
    if abs(len(word) - len(model)) > 1 or len(word) < 4:
        return False
    k = 0
    while k < min(len(word), len(model)) and word[k] == model[k]:
        k += 1
    a, b = word[k:], model[k:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[:2][::-1] and a[2:] == b[2:])


# Words that make a notice about another work a work of its own.
_NOTICES = {"correction": "correction", "corrigendum": "correction", "erratum": "correction", "reply": "reply", "response": "reply", "comment": "comment", "retraction": "retraction", "addendum": "addendum"}


def kind_of(words: list[str], open_end: bool) -> tuple[str, list[str]]:
    """What sets a work apart from its namesakes (notice, part, series), and the words that name it.

    ``open_end``: the title was cut off, so part and series are unknown, written ``?`` at the end.
    """
    notice, rest = "", words
    if words:
        for model, name in _NOTICES.items():
            if _near(words[0], model) and (len(words) == 1 or "to" in words[1:3] or "on" in words[1:3] or words[1:2] == ["of"]):
                notice = name
                rest = [w for i, w in enumerate(words) if i and not (w in ("to", "on", "of") and i < 3)] or words
                break
    part, series, kept = "", "", []
    i = 0
    while i < len(rest):
        w, after = rest[i], rest[i + 1] if i + 1 < len(rest) else ""
        if i and _near(w, "part") and (_ROMAN.match(after) or after.isdigit()):
            part = after
            i += 2
        elif i and _ORDINAL.match(w) and _near(after, "series"):
            series += w[0]
            i += 2
        else:
            kept.append(w)
            i += 1
    tail = f"{part}/{series}" if part or series else ("?" if open_end else "/")
    return f"{notice}:{tail}", kept


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CUT = re.compile(r"\s*(?:\.\.\.|…|\[truncated\]|\(abstract truncated\)|\[\.\.\.\])\s*$", re.I)
_LABEL = re.compile(r"^\s*(?:abstract|summary|background)\s*[:.\-]?\s+", re.I)


def sentences_of(text: str | None) -> list[str]:
    """Normal forms of the whole sentences of an abstract; one cut off at the end is left out."""
    if not text or len(text) < 25:
        return []
    text = _LABEL.sub("", text).rstrip()
    end = text[-24:]
    cut = _CUT.search(end) if end[-1:] in ".…])" else None
    parts = [p for p in _SENTENCE.split((text[: len(text) - len(end) + cut.start()] if cut else text).strip()) if p]
    if parts and (cut or parts[-1][-1] not in ".!?"):
        parts.pop()
    return [" ".join(p.lower().split()) for p in parts]


# What stands where nobody is named.
_NOBODY = frozenset("anonymous|anon|unknown|n a|na|no authors listed|no author|none|et al|various|various authors|author unknown|authors|staff|editor|editors|null".split("|"))


def is_nobody(name: str | None) -> bool:
    """Whether a name stands for an absent author."""
    if not name or len(name) > 40:
        return not name
    words = words_of(name)
    return not words or " ".join(words) in _NOBODY
