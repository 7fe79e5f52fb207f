from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lectern.functions import sequential as S
from lectern.functions import text as T
from lectern.operators.dedup import greedy_dedup
from lectern.operators.retrieval import bm25
from lectern.sources import exports, feeds
from lectern.streaming.seen import push_unseen, windowed_counts


def _walk(rows):
    seen_a, seen_b, kept = set(), set(), set()
    for pos, a, b in sorted(r for r in rows if r[0] is not None):
        if (a and a in seen_a) or (b and b in seen_b):
            continue
        if a:
            seen_a.add(a)
        if b:
            seen_b.add(b)
        kept.add(pos)
    return kept


def test_greedy_dedup_is_the_walk(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.choice([None, "", *"abcdefghijkl"]), rnd.choice([None, "", *"mnopqrstuvwx"])) for k in range(60)] + [(None, "a", "m")]
    df = spark.createDataFrame(rows, "pos long, d string, t string")
    assert {r.pos for r in greedy_dedup(df, "pos", ("d", "t")).collect()} == _walk(rows)
    assert greedy_dedup(df.limit(0), "pos", ("d", "t")).count() == 0


def test_bm25_falls_back_to_overlap(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (3, None), (4, "")], "id long, t string")
    asked = spark.createDataFrame([(1, "red"), (2, ""), (3, "图像 pear")], "q int, text string")
    got = {(r.q, r.id): r.score for r in bm25(docs, "id", "t", asked, "q", "text", 5).collect()}
    assert {(1, 1), (1, 2), (3, 2)} == set(got)


def test_tokens(spark):
    df = spark.createDataFrame([("Alpha-2 b 图像处理 字",), (None,)], "t string")
    assert [r.x for r in df.select(T.tokens("t").alias("x")).collect()] == [["alpha-2", "图像", "像处", "处理", "字"], []]


def test_keys(spark):
    df = spark.createDataFrame([(" https://doi.org/10.1/AB/ ",), ("DOI: 10.1/ab",), (None,)], "d string")
    assert [r.x for r in df.select(T.normalize_doi("d").alias("x")).collect()] == ["10.1/ab", "10.1/ab", ""]
    cites = spark.createDataFrame([("[06,7]",), ("（10，11）",), ("2019",), ("[6–9]",), (None,)], "c string")
    assert [r.x for r in cites.select(T.citation_key("c").alias("x")).collect()] == ["6,7", "10,11", None, "6-9", None]
    sizes = spark.createDataFrame([(1023,), (134400,), (None,)], "n long")
    assert [r.x for r in sizes.select(T.human_size(F.col("n")).alias("x")).collect()] == ["1023 B", "131.2 KB", "0 B"]


def test_chunks_lose_nothing():
    text = "One two three. " * 40 + "x" * 100
    parts = S.chunks_of(text, 60)
    assert all(0 < len(p) <= 60 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert S.chunks_of(None, 5) == [] and S.chunks_of("  ", 5) == []


def test_figures():
    assert S.figure_refs_of("See Fig. 2 and 3, Tables 4-6, 图十二 and Figure S1; 地图3") == ["figure:2", "figure:3", "table:4", "table:5", "table:6", "figure:12", "figure:s1"]
    assert S.caption_of("Table 3. Doses") == "table:3" and S.caption_of("As in Table 3") is None


def test_cliches_merge():
    text = "We delve into it. 值得注意的是 x"
    assert [text[a:b] for a, b in S.cliches_of(text)] == ["delve into", "值得注意的是"]


def test_tolerant_json():
    good = {"a": 1, "b": "x"}
    for raw in ('{"a": 1, "b": "x"}', 'Sure:\n```json\n{"a": 1, "b": "x",}\n```', 'text {"a": 1, "b": "x"} more', "｛\"a\"：1，\"b\"：\"x\"｝"):
        assert S.tolerant_json_of(raw) == good
    assert S.tolerant_json_of('{"a": "two\nlines"}') == {"a": "two\nlines"}
    assert S.tolerant_json_of('{"a": 1, "b": {"c": [1, 2') == {"a": 1, "b": {"c": [1, 2]}}
    assert S.tolerant_json_of("[1]") is None and S.tolerant_json_of(None) is None


def test_html():
    text, links = S.visible_text_of('<p>One <b>two</b></p><script>x</script><a href="/a">A b</a><a href="/a">C</a>')
    assert text == "One two\nA bC" and links == [("/a", "A b")]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": \n')
    good, corrupt = feeds.read_json_store(spark, str(tmp_path / "a.json"), "k int")
    assert [r.k for r in good.collect()] == [1] and corrupt.count() == 1
    (tmp_path / "a.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2001 Mar</MedlineDate></PubDate></JournalIssue></Journal>"
        "<Abstract><AbstractText>A.</AbstractText><AbstractText>B.</AbstractText></Abstract><AuthorList><Author><LastName>Li</LastName><Initials>X</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></Set>"
    )
    (row,) = feeds.read_articles(spark, str(tmp_path / "a.xml")).collect()
    assert (row.pmid, row.authors, row.pub_year, row.abstract) == ("7", "Li X, Group", "2001", "A.\nB.")
    work = json.dumps({"title": "T", "ids": {"pmid": "https://x/9"}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": f"N{i}"}} for i in range(7)]})
    (row,) = feeds.works_of_json(spark.createDataFrame([(work,), ('{"title": " "}',)], "j string"), "j").collect()
    assert (row.pmid, row.abstract, row.authors, row.cited_by) == ("9", "a b a", "N0, N1, N2, N3, N4 et al.", 0)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("T", "Smith J, et al.", "2001", None, "", "10.1/x", None, "5")], "title string, authors string, pub_year string, journal string, abstract string, doi string, url string, pmid string")
    exports.write_ris(df, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["TY  - JOUR", "TI  - T", "AU  - Smith, J.", "PY  - 2001", "DO  - 10.1/x", "ID  - 5", "ER  - "]
    exports.write_csv(df, ["title", "doi"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0].doi == "10.1/x"


def test_ris_blocks_of_all_papers_against_brute_force(spark, tmp_path):
    from lectern.plans.documents import QUERIES

    fields = ("paper_id", "title", "authors", "pub_year", "journal", "abstract", "doi", "url", "pmid")
    people = [None, "", "Li X", "Smith JA, O'Neil Mary K, et al.", "WHO Group, et al", "Plato", " , Ng A B,,Ota C D E", "Čapek K, 王 X"]
    rows = [(k, (f"T{k}", None, "")[k % 3], a, ("2001", "", None)[k % 3], None, "A. B." if k % 2 else "", f"10.1/{k}", "u", None) for k, a in enumerate(people)]
    spark.createDataFrame(rows, "paper_id long, " + ", ".join(f"{f} string" for f in fields[1:])).write.parquet(str(tmp_path / "external_papers.parquet"))

    def author(part):
        family, *rest = part.split()
        return f"{family}, {' '.join(w + '.' if all(len(x) == 1 for x in rest) else w for w in rest)}" if rest else part

    want = {}
    for row in rows:
        r = dict(zip(fields, row))
        parts = [p.strip() for p in (r["authors"] or "").split(",")]
        lines = ["TY  - JOUR", f"TI  - {r['title'] or ''}"] + [f"AU  - {author(p)}" for p in parts if p and p.lower().rstrip(".") != "et al"]
        lines += [f"{t}  - {r[c]}" for t, c in (("PY", "pub_year"), ("JO", "journal"), ("AB", "abstract"), ("DO", "doi"), ("UR", "url"), ("ID", "pmid")) if r[c]]
        want[r["paper_id"]] = "\n".join([*lines, "ER  - "])
    assert {r.paper_id: r.block for r in QUERIES["k3_ris_blocks"](spark, str(tmp_path)).collect()} == want


def test_streams(spark, tmp_path):
    schema = "paper_id long, doi string, pmid string, arxiv_id string, title string"
    src, seen, feed = (str(tmp_path / n) for n in ("src", "seen", "feed"))
    spark.createDataFrame([(1, "10.1/a", "", "", "x"), (2, "10.1/a", "", "", "x"), (3, "", "", "", "")], schema).write.parquet(src)
    for _ in range(2):
        push_unseen(spark.readStream.schema(schema).parquet(src), seen, feed, str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(4, "DOI:10.1/A", "", "", "y"), (5, "", "9", "", "z")], schema).write.mode("append").parquet(src)
    assert {(r.identity, r.paper_id) for r in spark.read.parquet(feed).select("identity", "paper_id").collect()} == {("doi:10.1/a", 1), ("pmid:9", 5)}
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:06:00", "a", 2.0)], "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value")
    assert windowed_counts(events).count() == 2


def test_registry_answers():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
