"""Splitting oversized texts at natural boundaries with overlap.

Every position of a text is joined to its farthest legal successor: the end of the longest piece that may
begin there, at the best boundary in reach. Squaring that successor table (succ = succ[succ]) doubles the
steps it makes, and after log2(pieces) squarings all cuts that the greedy walk from the beginning would make
are known; no walk is made. A text's tables are arrays where the text lies, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks that end a sentence, those of scripts without spaces apart, and what may close after them.
_ENDS = ".!?;。！？；"
_ENDS_ALONE = "。！？；"
_CLOSERS = "\"'”’»)]}」』）】"
#: Kinds of a cut.
HARD, SPACE, SENTENCE, PARAGRAPH, LAST = range(5)
KINDS = ("hard", "space", "sentence", "paragraph", "last")
#: Characters whose tables are held at once; the cuts of a longer text are found stretch by stretch.
_STRETCH = 1 << 22


@dataclass(frozen=True)
class PieceOptions:
    """limit: most characters of a piece. overlap: characters repeated from the piece before. A cut is looked
    for in the last half of a piece's new characters first, best kind first; then in the last three quarters;
    failing that the piece is cut at the limit."""

    limit: int = 1200
    overlap: int = 120

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit:
            raise ValueError("overlap must be at least 0 and below limit")


def _table(chars: str) -> np.ndarray:
    """Membership by code point; those above the table are never members."""
    found = np.zeros(0x10000, bool)
    found[[ord(c) for c in chars]] = True
    return found


_SPACES = _table("".join(chr(c) for c in range(0x10000) if chr(c).isspace()))
_END, _ALONE, _CLOSE = _table(_ENDS), _table(_ENDS_ALONE), _table(_CLOSERS)


def _has(codes: np.ndarray, members: np.ndarray) -> np.ndarray:
    return members[np.minimum(codes, 0xFFFF)]


def _latest(mask: np.ndarray) -> np.ndarray:
    """At each place, the last place so far where the mask is set, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int64), -1))


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Kind of a cut before each place 0..n of a text: hard where there is no boundary.

    A paragraph ends with an empty line or a form feed, a sentence with an end mark, what closes after it,
    and white space (none is needed after the marks of scripts without spaces); the cut follows the space.
    """
    n = len(codes)
    kinds = np.zeros(n + 1, np.int8)
    if not n:
        return kinds
    space, closing, mark = _has(codes, _SPACES), _has(codes, _CLOSE), _has(codes, _END)
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(after):
        kinds[after] = SPACE
        word = _latest(~space)[after - 1]
        inner = _latest(~space & ~closing)[after - 1]
        gap = _latest(space)[np.maximum(word, 0)]  # the space before the last word: closers must not reach beyond it
        ended = (word >= 0) & (mark[np.maximum(word, 0)] | ((inner > gap) & mark[np.maximum(inner, 0)]))
        kinds[after[ended]] = SENTENCE
        lines = np.cumsum((codes == 10) + 2 * (codes == 12))
        kinds[after[lines[after - 1] - np.where(word >= 0, lines[np.maximum(word, 0)], 0) >= 2]] = PARAGRAPH
    alone = _has(codes, _ALONE)
    kinds[1:n][alone[:-1] & ~mark[1:] & ~space[1:] & ~closing[1:]] = SENTENCE
    return kinds


def cuts(codes: np.ndarray, options: PieceOptions, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces of one text and the kinds of the cuts there; ``whole``: the text ends with the codes."""
    n, fresh = len(codes), options.limit - options.overlap
    kinds = boundaries(codes)
    place = np.arange(n + 1, dtype=np.int64)
    reach = place + fresh
    reach[0] = options.limit
    capped = np.minimum(reach, n)
    succ = capped.copy()
    latest = {least: _latest(kinds >= least)[capped] for least in (SPACE, SENTENCE, PARAGRAPH)}
    for share, least in ((fresh // 4, SPACE), (fresh // 2, SPACE), (fresh // 2, SENTENCE), (fresh // 2, PARAGRAPH)):  # a better one overrides
        found = latest[least]
        succ = np.where(found > place + share, found, succ)
    succ = np.where(reach >= n, n, succ)
    ends = succ[:1]
    for _ in range(max(1, int(2 * n // fresh + 2).bit_length() + 2)):
        ends = np.unique(np.concatenate([ends, succ[ends]]))
        succ = succ[succ]
    how = kinds[ends].copy()
    if whole:
        how[-1] = LAST
    return ends, how


def all_cuts(text: str, options: PieceOptions) -> tuple[np.ndarray, np.ndarray]:
    """Ends and kinds of a text of any length: stretch by stretch, each begun at the last cut well within the one before."""
    ends, kinds, at = [], [], 0
    while True:
        # a stretch after the first begins with the overlap, so that its first piece has the full length
        lead = options.overlap if at else 0
        part = text[at - lead : at - lead + _STRETCH]
        last = at - lead + len(part) >= len(text)
        some, how = cuts(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), options, last)
        if not last:
            keep = some <= len(part) - 2 * options.limit
            some, how = some[keep], how[keep]
        ends.append(some + at - lead)
        kinds.append(how)
        if last:
            return np.concatenate(ends), np.concatenate(kinds)
        at = int(ends[-1][-1])


def split_oversized(df: DataFrame, key: str, text: str, options: PieceOptions = PieceOptions(), with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, piece, start, end, cut, hard[, content]) for every row whose text exceeds the limit.

    start and end are code points of the text; the pieces cover it, each but the first repeats the last
    ``overlap`` characters of the one before, none exceeds ``limit``. cut says what the piece ends at. hard is
    1 for a text with more than ``limit`` characters in a row without white space or end mark. Null, empty and
    short texts give no rows, repeated rows give repeated pieces, an empty table gives none. Columns of the
    input other than those named are dropped, so they can't clash.
    """
    stop = re.compile(rf"[\s{_ENDS}]")

    def is_hard(value: str, ends: np.ndarray, kinds: np.ndarray) -> bool:
        """Whether a step of the table that found no boundary in reach lies in a stretch longer than a piece without any
        white space or end mark. A longer stretch can't be passed without such a step."""
        for place in ends[kinds == HARD].tolist():
            before, after = value[max(0, place - options.limit - 1) : place][::-1], value[place : place + options.limit + 1]
            left, right = stop.search(before), stop.search(after)
            if (left.start() if left else len(before)) + (right.start() if right else len(after)) > options.limit:
                return True
        return False

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, end, cut, hard, content = [], [], [], [], [], [], []
            size = 0
            for i in range(batch.num_rows):
                value = batch.column(0)[i].as_py()
                ends, kinds = all_cuts(value, options)
                begins = [0, *(int(e) - options.overlap for e in ends[:-1])]
                row += [i] * len(ends)
                piece += range(len(ends))
                start += begins
                end += ends.tolist()
                cut += [KINDS[k] for k in kinds]
                hard += [int(is_hard(value, ends, kinds))] * len(ends)
                if with_text:
                    content += [value[a:b] for a, b in zip(begins, ends)]
                size += len(value)
                if size > _STRETCH or i == batch.num_rows - 1:
                    columns = [batch.column(j).take(pa.array(row, pa.int64())) for j in range(1, batch.num_columns)]
                    columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(cut, pa.string()), pa.array(hard, pa.int64())]
                    columns += [pa.array(content, pa.string())] if with_text else []
                    yield pa.RecordBatch.from_arrays(columns, names)
                    row, piece, start, end, cut, hard, content = [], [], [], [], [], [], []
                    size = 0

    kept = (key, *keep)
    names = [*kept, "piece", "start", "end", "cut", "hard", *(["content"] if with_text else [])]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", piece int, start long, end long, cut string, hard long" + ", content string" * with_text
    return df.where(F.length(text) > options.limit).select(F.col(text).alias("_text"), *kept).mapInArrow(of_batches, schema)
