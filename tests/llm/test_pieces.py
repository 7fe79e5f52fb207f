"""Pieces against their definition and against the greedy walk they stand for."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pieces
from lectern.llm.pieces import HARD, PARAGRAPH, SENTENCE, SPACE, PieceOptions, all_cuts, boundaries, split_oversized

ALPHABET = st.sampled_from(list("ab .\n。!\x0c)") + ["xxxxxxxx", "word ", "End. ", "\n\n", "长句。"])


def _walk(text: str, o: PieceOptions) -> list[int]:
    kinds, n, fresh = boundaries(np.array([ord(c) for c in text], np.uint32)), len(text), o.limit - o.overlap
    ends, at = [], 0
    while at < n:
        reach = at + (fresh if at else o.limit)
        if reach >= n:
            ends.append(n)
            break
        for share, least in ((fresh // 2, PARAGRAPH), (fresh // 2, SENTENCE), (fresh // 2, SPACE), (fresh // 4, SPACE)):
            found = [p for p in range(at + share + 1, reach + 1) if kinds[p] >= least]
            if found:
                at = found[-1]
                break
        else:
            at = reach
        ends.append(at)
    return ends


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=120), st.sampled_from([(12, 0), (20, 4), (30, 12)]))
def test_doubling_is_the_greedy_walk(parts, size):
    text, o = "".join(parts), PieceOptions(*size)
    assert all_cuts(text, o)[0].tolist() == _walk(text, o)


def test_stretches_join(monkeypatch):
    text = ("Some words here. " * 40 + "x" * 90 + "\n\n") * 6
    o = PieceOptions(60, 10)
    monkeypatch.setattr(pieces, "_STRETCH", 700)
    ends = all_cuts(text, o)[0]
    assert ends[-1] == len(text)
    assert all(0 < b - a <= 50 for a, b in zip(ends[:-1], ends[1:]))


def test_kinds():
    text = 'He said "go." Then\n\nnext 好。好 x'
    kinds = boundaries(np.array([ord(c) for c in text], np.uint32))
    assert kinds[text.index("Then")] == SENTENCE
    assert kinds[text.index("next")] == PARAGRAPH
    assert kinds[text.index("said")] == SPACE
    assert kinds[text.index("。") + 1] == SENTENCE
    assert kinds[1] == HARD


def test_rows(spark):
    rows = [(1, "a" * 1300, "p"), (2, None, "p"), (3, "", "p"), (4, "w " * 700, None), (4, "w " * 700, None), (5, "x" * 1200, "q"), (None, "z. " * 500, "q")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    got = split_oversized(df, "id", "text").collect()
    assert {r.id for r in got} == {1, 4, None}
    for r in got:
        assert len(r.content) == r.end - r.start <= 1200
    one = sorted((r.piece, r.start, r.end, r.hard) for r in got if r.id == 1)
    assert one == [(0, 0, 1200, 1), (1, 1080, 1300, 1)]
    assert {r.hard for r in got if r.id == 4} == {0}
    assert split_oversized(df.limit(0), "id", "text").count() == 0


def test_options():
    with pytest.raises(ValueError):
        PieceOptions(10, 10)
