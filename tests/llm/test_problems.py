"""The dealt operators on small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import itertools
import random
import string

import numpy as np
import pytest

from lectern.llm import match as M
from lectern.llm import names as N
from lectern.llm import scans as C
from lectern.llm import textnorm as X
from lectern.llm.mixing import MixOptions, draw, plan
from lectern.llm.packing import PackOptions, fill, pack, token_counts
from lectern.llm.spans import SpanOptions, shared_spans, sharing_pairs, stretches
from lectern.llm import survivor as V
from lectern.llm.survivor import best_text, most_trusted


def _noise(rnd, n):
    return "".join(rnd.choice(string.ascii_letters + "  é图") for _ in range(n))


def _brute_pairs(rows, span):
    found = set()
    for (a, x), (b, y) in itertools.combinations(sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]), 2):
        if a != b and any(x[i : i + span] in y for i in range(len(x) - span + 1)):
            found.add((a, b))
    return found


@pytest.mark.parametrize("hot", [48, 1])
def test_spans_against_brute_force(spark, hot):
    rnd = random.Random(4)
    shared = [_noise(rnd, n) for n in (160, 159, 400, 170)]
    rows = [(k, _noise(rnd, 200) + rnd.choice(shared) * (k % 3 > 0) + _noise(rnd, rnd.randrange(120))) for k in range(24)]
    rows += [(100, shared[2]), (101, shared[2]), (102, None), (103, ""), (None, shared[2]), (104, "-" * 500), (105, "ab" * 130 + "-" * 180), (100, shared[2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, body string, doc string")
    o = SpanOptions(hot=hot)
    found = shared_spans(df, "id", "body", o)
    assert {tuple(r) for r in sharing_pairs(found).collect()} == _brute_pairs(rows, 160)
    texts = {k: t for k, t in rows if k is not None and t}
    covered = {}
    for r in stretches(found, o).collect():
        covered.setdefault(r.doc, set()).update(range(r.start, r.end))
    for k, t in texts.items():
        want = {p for i in range(len(t) - 159) if any(t[i : i + 160] in u for j, u in texts.items() if j != k) for p in range(i, i + 160)}
        assert covered.get(k, set()) == want


def test_spans_beyond_the_sketch(spark):
    rnd = random.Random(9)
    shared = _noise(rnd, 300)
    rows = [(k, _noise(rnd, 300) + shared * (k in (3, 7)) + _noise(rnd, 50)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, body string")
    # a sketch so small that every window passes it: the exact grouping decides alone
    found = shared_spans(df, "id", "body", SpanOptions(max_counter_bits=4))
    assert {tuple(r) for r in sharing_pairs(found).collect()} == {(3, 7)}


def test_an_anchor_in_every_text(spark):
    rows = [(k, "x" * 200 + str(k) * 3) for k in range(300)]
    found = shared_spans(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    assert sharing_pairs(found).count() == 300 * 299 // 2


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "id long, body string")
    found = shared_spans(df, "id", "body")
    assert sharing_pairs(found).count() == 0 and stretches(found).count() == 0


def test_reading_names():
    lexicon = N.Lexicon({"nadia", "william", "bill", "susan"}, {"bill": {"william"}})
    lexicon.prepare()
    for written in ("Susumsen, Nadia S.", "Nadia S. Susumsen", "Susumsen Nadia S", "SUSUMSEN, NADIA S.", "Susumsèn, Nadia S."):
        assert N.read_name(written, lexicon)[:3] == ("susumsen", "nadia", "ns"), written
    assert N.read_name("N. S. Susumsen", lexicon)[:3] == ("susumsen", "", "ns")
    assert N.read_name("Stroke Network Dosen", lexicon) == N.read_name("Dosen Stroke Network", lexicon)
    assert N.read_name("Anonymous", lexicon) is None and N.read_name("  ", lexicon) is None
    assert lexicon.canonical("bill") == {"william"} and lexicon.canonical("nadai") == {"nadia"}


def test_name_groups(spark):
    base = ["Susumsen, Nadia", "Nadia Susumsen", "Susumsen Nadia", "N. Susumsen", "Susumsen, N.", "Velaud, Olga", "Olga Velaud", "Velaud, Omar", None, "", "Anonymous", "Sasen Ocean Network", "Ocean Network Sasen"]
    base += [f"{f}, {g}" for f in ("Aaaler", "Bbbner", "Cccmis", "Dddkov") for g in ("Nadia", "Olga", "Omar")]
    df = spark.createDataFrame([(n, 1) for n in base * 3], "name string, entity int")
    groups = {r.name: r.entity for r in N.name_groups(df).collect()}
    assert len({groups[n] for n in base[:5]}) == 1
    assert groups["Velaud, Olga"] == groups["Olga Velaud"] != groups["Velaud, Omar"]
    assert groups["Sasen Ocean Network"] == groups["Ocean Network Sasen"]
    assert "Anonymous" not in groups and None not in groups
    assert N.name_groups(df.limit(0)).count() == 0


def test_every_slip_in_a_family_name_is_a_pair(spark):
    rnd = random.Random(7)
    names, want = set(), set()
    for size in range(3, 9):
        for _ in range(12):
            name = "".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(size))
            k = rnd.randrange(size)
            other = [name[:k] + "x" + name[k + 1 :], name[:k] + "x" + name[k:], name[: k - 1] + name[k] + name[k - 1] + name[k + 1 :] if k else name, name[:k] + name[k + 1 :] if size > 3 else name]
            names |= {name, *other}
            want |= {p for o in other if o != name for p in ((name, o), (o, name))}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "t string")
    found = {(r.a, r.b) for r in N.similar_names(df, N.NameOptions()).collect()}
    assert want - found == set()


def test_a_name_keeps_all_its_partners(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(n))
    base = word(24)
    partners = {base[:20] + x + base[21] + y + base[23] for x, y in itertools.product("qwxyj", repeat=2)} | {base[:2] + x + y + base[4:] for x, y in itertools.product("qwx", repeat=2)}
    df = spark.createDataFrame([(n,) for n in [base, *partners, *(word(9) for _ in range(400))]], "t string")
    found = {r.b for r in N.similar_names(df, N.NameOptions()).where(f"a = '{base}'").collect()}
    assert len(partners) == 34 and partners - found == set()


def test_similar_names_are_compared_once(spark):
    rnd = random.Random(10)
    names = {"".join(rnd.choice("abcde\u4e00\U00020000") for _ in range(rnd.randrange(3, 9))) for _ in range(300)}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "t string")
    near = N.similar_names(df, N.NameOptions())
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()  # both orders of a pair are read, not found anew
    bags = df.select("t", N._bag("t").alias("bag"))
    a, b = (bags.select(N.F.col("t").alias(x), N.F.col("bag").alias(f"bag_{x}")) for x in "ab")
    bits = {(r.a, r.b): (r.edits, r.bag_a, r.bag_b) for r in a.crossJoin(b).select("*", N.F.levenshtein("a", "b").alias("edits")).collect()}
    lost = {p: max((x & ~y).bit_count(), (y & ~x).bit_count()) for p, (_, x, y) in ((p, (v[0], v[1] % 2**64, v[2] % 2**64)) for p, v in bits.items())}
    assert all(lost[p] <= v[0] for p, v in bits.items()) and any(lost[p] > 2 for p in bits)


def test_long_names_are_compared_whole(spark):
    stem = "a" * 90
    names = [f"{stem}bcdf, Nadia", f"{stem}ghik, Nadia", "Velaud, A. B. C. D. E. F. G. H. I.", "Velaud, A. B. C. D. E. F. G. H. K."]
    groups = N.name_groups(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len({r.entity for r in groups}) == 4


def test_nicknames_beside_hot_family_names(spark):
    rnd = random.Random(9)
    given = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("dan", "fel", "gor", "hus", "jim", "kel", "lor", "mas", "nit", "pus", "ban", "tel", "sor", "dus", "fim", "mel", "nor", "kas", "rit", "lus")]
    rows = []
    for k in range(40):
        beside = rnd.sample(given, 35) + (["robert"] if k < 16 else []) + (["bobby"] if k < 8 else [])
        rows += [(f"fam{chr(97 + k // 26)}{chr(97 + k % 26)}, {g}",) for g in beside]
    lexicon = N._lexicon(spark.createDataFrame(rows, "name string"), None, N.NameOptions())
    assert lexicon.stands_for == {"bobby": {"robert"}}


def test_average_linkage_parts_a_shared_initial():
    got = N._linkage([(1, 3, 0.85), (2, 3, 0.85)], {1: 9, 2: 1, 3: 1}, 0.5)
    assert got[1] == got[3] != got[2]


def _records(rows):
    fields = ("title", "names", "year", "doi", "abstract", "pmid", "preprint", "venue")
    return [(k, 0, *(r.get(f) for f in fields)) for k, r in enumerate(rows)]


_SCHEMA = "rid long, side int, title string, names string, year string, doi string, abstract string, pmid string, preprint string, venue string"


def test_matching(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(9)) for _ in range(300)]
    rows = []
    for k in range(60):
        t, a = " ".join(rnd.sample(words, 6)), ", ".join(f"Xan {rnd.choice(words).title()}" for _ in range(3))
        one = {"title": t.title(), "names": a, "year": str(1990 + k % 30), "doi": f"10.1234/ab{k}", "abstract": f"{' '.join(rnd.sample(words, 12))} one. {' '.join(rnd.sample(words, 12))} two.", "venue": "J"}
        rows += [one, one | {"doi": None, "title": t.upper(), "abstract": None}]
        if k < 6:
            rows.append(one | {"title": t.title() + ". Part II", "doi": f"10.1234/zz{k}", "abstract": f"{' '.join(rnd.sample(words, 12))} three.", "year": str(1991 + k % 30)})
    rows += [{}, {"title": ""}, rows[0]]
    df = spark.createDataFrame(_records(rows), _SCHEMA)
    records = M.prepare(df)
    work = {r.rid: r.work for r in M.works(records, M.match(records)).collect()}
    k = 0
    for i, r in enumerate(rows[:-3]):
        if r["title"].endswith("Part II"):
            assert work.get(i, i) == i
        elif r["doi"] is None:
            assert work[i] == work[i - 1]
            k += 1
    assert k == 60 and work[len(rows) - 1] == work[0] and len(rows) - 2 not in work
    empty = M.prepare(df.limit(0))
    assert M.works(empty, M.match(empty)).count() == 0


def _candidates(spark, rows):
    records = M.prepare(spark.createDataFrame(_records(rows), _SCHEMA))
    return {(r.a, r.b) for r in M.candidates(records, M.MatchOptions()).collect()}


def test_slips_meet_across_years_whatever_the_size(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(9)) for _ in range(24)]
    rows = [{"title": " ".join(rnd.sample(words, 6)), "year": str(1990 + k % 9)} for k in range(120)]
    pairs = set()
    for k in range(0, 120, 4):
        t = rows[k]["title"].split()
        t[rnd.randrange(6)] += "x"
        pairs.add((k, len(rows)))
        rows.append({"title": " ".join(t), "year": (None, str(2005 + k % 3))[k % 8 > 0]})
    assert pairs - _candidates(spark, rows) == set()


def test_large_blocks_lose_nothing(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(9)) for _ in range(90)]
    title = words[:6]
    rows = []
    for k in range(70):  # forms of one work: other years or none, titles damaged at any place
        t = title.copy()
        t[k % 6] = rnd.choice("abcdefgh") + t[k % 6][1:] + "y" * (k % 4)
        rows.append({"title": " ".join(t), "doi": "10.1234/ab1", "year": (None, "2001", "2004")[k % 3]})
    rows += [rows[3]] * 50
    # a block of chance: two shared words, the rest differs but for pairs of years apart
    chance = [{"title": " ".join([words[10], words[11], *rnd.sample(words[12:], 5)]), "year": str(1980 + k)} for k in range(60)]
    first = len(rows)
    rows += chance + [c | {"year": None, "title": c["title"] + "s"} for c in chance]
    found = _candidates(spark, rows)
    least = [rows.index(r) for r in rows[:first]]  # rows alike in everything are tied to the least of them
    assert set(itertools.combinations(sorted(set(least)), 2)) - found == set()
    assert {(a, b) for b, a in enumerate(least) if a < b} - found == set()
    assert {(first + k, first + 60 + k) for k in range(60)} - found == set()


def test_pairs_whatever_the_size_of_blocks(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(9)) for _ in range(40)]
    people = [w[:6].title() for w in words]
    rows = []
    for k in range(50):  # two shared words by chance; titles of nothing else; three words that all have
        some = rnd.sample(words[2:12], 4)
        rows.append({"title": " ".join([words[0], words[1], *some]), "names": ", ".join(rnd.sample(people, k % 4)), "abstract": f"{words[3]} {words[4]} {words[k % 9]} said."})
        rows.append({"title": f"{words[20]} {words[21]}", "names": ", ".join(rnd.sample(people, k % 3)), "year": str(1990 + k % 5)})
        rows.append({"title": " ".join([*words[30:33], words[34 + k % 5]]), "year": str(1990 + k)})
    rows += rows[:3]
    records = M.prepare(spark.createDataFrame(_records(rows), _SCHEMA)).cache()
    of = [{tuple(r) for r in M.candidates(records, M.MatchOptions(block=n)).collect()} for n in (2, 40, 10**6)]
    assert of[0] == of[1] == of[2]
    content = {r.rid: (set(r.words), set(r.names)) for r in records.collect()}
    reviews = [k for k in range(150) if k % 3 == 1]
    want = set()
    for a, b in itertools.combinations(reviews, 2):
        (_, x), (_, y) = content[a], content[b]
        if not x or not y or x & y:
            want.add((a, b))
    want = {(a, b) for a, b in want if not any(rows[r] in rows[:r] for r in (a, b))}
    assert want - {(r[0], r[1]) for r in of[0] if r[3]} == set()


def test_copies_have_all_their_pairs(spark):
    one = {"title": "Alpha beta gamma delta", "names": "Xan Velaud", "doi": "10.1234/ab1", "year": "2001"}
    rows = [one, one, one, one | {"year": "2002"}, one | {"year": "2002"}]
    records = M.prepare(spark.createDataFrame(_records(rows), _SCHEMA)).cache()
    scored = M.with_copies(M.match(records), records).collect()
    assert sorted((r.a, r.b) for r in scored) == list(itertools.combinations(range(5), 2))


def test_what_many_abstracts_say_is_no_key(spark):
    told = ["This page was made by the publisher of it.", "All of its rights are held by somebody."]
    rows = [{"title": f"Title number {X.plain(chr(97 + k % 26))}{k} of works", "abstract": " ".join([*told, f"Only the work {k} has this sentence."])} for k in range(60)]
    records = M.without_common(M.prepare(spark.createDataFrame(_records(rows), _SCHEMA)), M.MatchOptions())
    assert {len(r.abstract) for r in records.collect()} == {1}


def test_abstracts_are_not_stored_anew(spark, monkeypatch):
    kept, keep = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, *by: kept.append(df.columns) or keep(df, *by))
    told = [f"This page {k} was made by the publisher of it." for k in range(3)]
    rows = [{"title": f"Title number {chr(97 + k % 26)}{k} of works", "abstract": " ".join([*told, f"Only the work {k} has this sentence."])} for k in range(60)]
    records = M.prepare(spark.createDataFrame(_records(rows), _SCHEMA)).cache()
    assert {len(r.abstract) for r in M.without_common(records, M.MatchOptions()).collect()} == {1}
    assert not any("abstract" in columns for columns in kept)


def test_copies_are_told_from_what_differs_in_nulls_and_bounds(spark):
    one = (7, 0, "t", [1], "k", [2, 3], None, 5, None, 2001, [9], None)
    other = [{3: [1, 2], 5: [3]}, {6: 5, 7: None}, {7: None, 8: 5}, {3: [], 5: [1, 2, 3]}, {10: []}, {10: [], 11: 9}]
    rows = [one, *(tuple(o.get(k, v) for k, v in enumerate(one)) for o in other)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate([*rows, *rows])], M._PREPARED)
    assert sorted((r.rid, r.first) for r in M.copies(df).collect()) == [(k + 7, k) for k in range(7)]


def test_evidence_is_its_rule(spark):
    some = [list(range(k, n)) for k in range(4) for n in range(k, k + 5)]
    sides = list(itertools.product(some, some))
    rnd = random.Random(12)
    cases = [(k, *rnd.choice(sides), *rnd.choice(sides)) for k in range(3000)]
    df = spark.createDataFrame(cases, "k int, wa array<int>, wb array<int>, na array<int>, nb array<int>")
    found = {r.k: r.e for r in df.select("k", M._evidence(("wa", "wb"), ("na", "nb")).alias("e")).collect()}
    for k, wa, wb, na, nb in cases:
        words, names, w, n = len({*wa} & {*wb}), len({*na} & {*nb}), min(len(wa), len(wb)), min(len(na), len(nb))
        assert found[k] == (words >= 3 or words >= w and (n == 0 or names > 0) or words >= 2 and n > 0 and names >= min(2, n)), cases[k]


def test_kinds():
    assert X.kind_of(X.words_of("Correction to: A b"), False)[0] == "correction:/"
    assert X.kind_of(X.words_of("A b. Part II"), False) == (":ii/", ["a", "b"])
    assert X.kind_of(X.words_of("A b..."), True)[0] == ":?"
    assert X.plain("ShismÃ¤r") == "shismar" and X.doi_of("DOI: 10.1234/AB1/ ") == "10.1234/ab1"


def _texts(*written):
    out = []
    for text, weight in written:
        parts, cut = V.parted(text)
        out.append(([X.plain(p) for p in parts], cut, weight))
    return out


def test_consensus():
    whole = "First thing was seen. Then the second came. A third ended it."
    texts = _texts(("First thing was seen. Then the sec...", 1.0), (whole + " " + whole, 1.0), ("Sign in here. " + whole, 1.0), (whole, 1.0))
    assert V.consensus(texts, {X.number(X.plain("Sign in here."))}) == (3, 0.0, True)
    assert not V.consensus(texts[:1], set())[2]


def test_the_vote_rejects_what_one_text_adds():
    whole = "First thing was seen. Then the second came. A third ended it."
    foreign = whole.replace(" A third", " Nobody else has ever written such words here. A third")
    texts = _texts((foreign, 1.5), (whole, 1.0), (whole.replace("seen", "sewn"), 1.0))
    assert V.consensus(texts, set()) == (1, 0.0, True)
    assert V.consensus(_texts((foreign, 1.0), (whole[:40] + "…", 3.0)), set()) == (0, 0.0, True)  # nothing speaks against it
    assert V.consensus(_texts((whole[:30], 9.0), (whole, 1.0)), set())[0] == 1


def _by_cells(a, b):
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            same = 2 if i and j and a[i - 1] == b[j - 1] else -1
            best[i, j] = max(best.get((i - 1, j), -99) - 1, best.get((i, j - 1), -99) - 1, best.get((i - 1, j - 1), -99) + same) if i or j else 0
    return best[len(a), len(b)]


@pytest.mark.parametrize("cells", [1 << 22, 4])
def test_alignment_is_the_best(monkeypatch, cells):
    monkeypatch.setattr(V, "_CELLS", cells)
    rnd = np.random.default_rng(11)
    for _ in range(60):
        a, b = rnd.integers(0, 4, rnd.integers(0, 14)), rnd.integers(0, 4, rnd.integers(0, 14))
        place = V.align(a, b)
        there = place[place >= 0]
        assert (np.diff(there) > 0).all()
        score = sum(2 if a[p] == b[k] else -1 for k, p in enumerate(place) if p >= 0) - (place < 0).sum() - (len(a) - len(there))
        assert score == _by_cells(a.tolist(), b.tolist())


def test_a_large_group(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    whole = "The " + " ".join(words) + " end of it."
    rows = [(1, k, whole.replace(words[k % 40], f"x{k}"), 1.0) for k in range(200)] + [(1, 900, whole, 1.0)]
    df = spark.createDataFrame(rows, "g long, r long, t string, w double")
    assert [(x.g, x.r, x.t) for x in V.best_text(df, "g", "t", "r", "w").collect()] == [(1, 900, whole)]
    monkeypatch.setattr(V, "_GO", 50)
    assert [(x.g, x.r) for x in V.best_text(df, "g", "t", "r", "w", with_text=False).collect()] == [(1, 900)]


def test_survivors(spark):
    whole = "First thing was seen by all of us. Then the second one came along. A third ended it for good."
    rows = [(1, 10, whole[:50] + "…", 1.0), (1, 11, "  " + whole, 1.0), (1, 12, whole, 1.0), (2, 20, None, 1.0), (3, 30, "n/a", 1.0)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "g long, r long, t string, w double, distance string")
    assert [(x.g, x.r) for x in best_text(df, "g", "t", "r", "w").collect()] == [(1, 11)]
    assert best_text(df.limit(0), "g", "t", "r", "w").count() == 0
    fields = {"t": (df["t"], df["t"], df["w"], df["r"])}
    assert {(x.g, x.field, x.r) for x in most_trusted(df, "g", fields, "r").collect() if x.g == 3} == {(3, "t", 30)}


def test_scans(spark):
    para = "The regular expression of the measured response was significantly higher among those patients"
    rows, pk = [], 0
    for doc in ("A", "B", "C", "D"):
        for page in range(1, 6):
            for n, (kind, text) in enumerate(
                [("header_footer", f"{page}  Annals of Things, Vol. 3"), ("body", para + " in all groups. It was measured twice."), ("body", f"{para} who were mea-\nsured by a cross-\nsectional design and also a cross-sectional one."), ("body", para if page < 5 else para + "."), ("body", str(page))], 1
            ):
                pk += 1
                rows.append((pk, doc, page, f"p{page}_e{n}", kind, text, 1.0))
    odd = [(900, "A", 3, "p3_e6", "body", "The measurcd rcsponse was signific@ntly higher.", 1.0), (901, None, None, None, None, None, None), (902, "A", 2, "p2_e6", "body", "", 1.0)]
    df = spark.createDataFrame(rows + odd + rows[:3], "elem_pk long, doc_key string, page int, element_id string, element_type string, text string, n double")
    noise = C.find_noise(df)
    got = {(r.elem_pk, r.defect) for r in C.defects(noise).collect()}
    by = {r[0]: r for r in rows}
    furniture = {k for k, d in got if d == "furniture"}
    assert furniture == {k for k, r in by.items() if r[3].endswith(("_e1", "_e5"))}
    assert {k for k, d in got if d == "hyphen"} == {k for k, r in by.items() if r[3].endswith("_e3")}
    assert (900, "misread") in got and all(k == 900 for k, d in got if d == "misread")
    ends = {k for k, d in got if d == "continues"}
    assert ends >= {k for k, r in by.items() if r[3].endswith("_e4") and r[2] < 5 and not (r[1] == "A" and r[2] == 3)}
    texts = [r.text for r in C.paragraphs(df, noise).collect()]
    assert any("measured response" in t and "significantly" in t for t in texts) and not any("Vol. 3" in t for t in texts)
    assert any("measured by a cross-sectional design" in t for t in texts)
    none = C.find_noise(df.limit(0))
    assert C.defects(none).count() == 0 and C.paragraphs(df.limit(0), none).count() == 0


@pytest.mark.parametrize("times", [1, 10, 100])
def test_misread_words_at_any_size(spark, times):
    counts = {"boundary": 600, "boiindary": 12, "subnetry": 90, "subrnetry": 2, "and": 29800, "arid": 700, "other": 970_000, "acidic": 610, "aciclic": 11}
    rows = [(w, n * times, sum(ord(c) ** 5 for c in w)) for w, n in counts.items()] + [("submetry", 90 * times, sum(ord(c) ** 5 for c in "submetry"))]
    df = spark.createDataFrame(rows, "word string, n long, hash long")
    got = {r.word: r.meant for r in C.misread_words(df, C.ScanOptions()).collect()}
    assert got == {"boiindary": "boundary", "subrnetry": "submetry", "aciclic": "acidic"}
    assert C.misread_words(df.limit(0), C.ScanOptions()).count() == 0


def test_packing_is_whole_and_within_limits():
    rnd = np.random.default_rng(3)
    tokens = rnd.integers(0, 500, 700)
    loss = tokens // 2
    where = pack(tokens, loss, 512, 12, 200 + 300)
    for c in np.unique(where):
        own = where == c
        assert tokens[own].sum() <= 512 and own.sum() <= 12 and loss[own].sum() <= 500
    assert tokens.sum() / (512 * (where.max() + 1)) > 0.97


def test_fill(spark):
    docs = spark.createDataFrame([(1, "word " * 3000, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (5, "odd", "x")], "id long, t string, tokens string")
    counted = token_counts(docs, "id", "t", PackOptions())
    budgets = spark.createDataFrame([("small", 100), ("none", 0), ("null", None)], "budget_name string, capacity_tokens int")
    got = fill(counted, budgets, "id").collect()
    assert {r.id for r in got} == {1, 2, 3, 4, 5} and {r.budget_name for r in got} == {"small"}
    one = sorted((r.piece, r.first_token, r.tokens) for r in got if r.id == 1)
    assert one[0] == (0, 0, 100) and all(a[1] + a[2] == b[1] for a, b in zip(one, one[1:]))
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert max(used.values()) <= 100
    assert fill(counted.limit(0), budgets, "id").count() == 0 and fill(counted, budgets.limit(0), "id").count() == 0


def test_plan_shares_what_capped_sources_lack():
    got = {p["source"]: p["demand"] for p in plan({"a": 1000, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 3)], 600)}
    assert got == {"a": 570, "b": 30}
    assert plan({}, [("a", 0.0, 1)]) == [] and plan({"a": 5}, [("a", 1.0, 0)])[0]["demand"] == 0


def test_draws(spark):
    rows = [(k, "A " if k % 3 else "b-c", 10 + k % 7) for k in range(900)] + [(5000, None, 4), (None, "a", 3), (5001, "a", 0)]
    items = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b_c", 0.6, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    draws, shares = draw(items, "id", targets, MixOptions(rows=100))
    got = draws.collect()
    assert max(r.repeat for r in got) <= 2 and all(0 <= r.position <= 1 for r in got)
    assert len({(r.id, r.repeat) for r in got}) == len(got)
    reached = {r.source: r for r in shares.collect()}
    assert reached["gone"].draws == 0 and not reached["gone"].met
    assert abs(sum(r.reached_share for r in reached.values()) - 1) < 1e-9
    assert reached["b_c"].drawn_tokens <= 2 * reached["b_c"].tokens
    none, few = draw(items.limit(0), "id", targets)
    assert none.count() == 0 and few.count() == 3
