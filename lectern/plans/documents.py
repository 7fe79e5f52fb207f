"""Queries over texts: retrieval, chunks, figures, dedup, layout folds, change detection and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import sequential as S
from lectern.functions import text as T
from lectern.operators.dedup import greedy_dedup
from lectern.operators.retrieval import bm25
from lectern.plans.relational import items
from lectern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col = F.col


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ASKED = ((1, "cortical hypophase and scheduler"), (2, "volcanic rainfall"), (3, "effects of the"))
_BM25 = """WITH asked(q, query) AS (VALUES (1, 'cortical hypophase and scheduler'), (2, 'volcanic rainfall'), (3, 'effects of the')),
docs AS (SELECT paper_id AS id, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9\\-_]+') AS words FROM external_papers),
size AS (SELECT count(*) AS total, avg(len(words)) AS mean_length FROM docs),
post AS (SELECT id, length, w, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS w FROM docs) GROUP BY ALL),
raw AS (SELECT w, ln((total - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, size GROUP BY w, total),
idf AS (SELECT w, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qw AS (SELECT q, unnest(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9\\-_]+')) AS w FROM asked),
scored AS (SELECT q, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS s FROM qw JOIN post USING (w) JOIN idf USING (w), size GROUP BY q, id)
SELECT q::INT AS question, id AS paper_id, round(s, 3) AS score, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id)::INT AS rank FROM scored WHERE s > 0 QUALIFY rank <= 10"""


@_query(_BM25)
def t1_bm25(spark, root):
    """The ten papers whose titles answer each of three questions best."""
    asked = spark.createDataFrame(_ASKED, "question int, query string")
    return bm25(table(spark, root, "external_papers"), "paper_id", "title", asked, "question", "query", 10)


@_query()
def t3_hybrid_ranking(spark, root):
    """Items found by metadata and by text first, then by text alone, then by metadata alone; eight per question."""
    asked = spark.createDataFrame(_ASKED, "question int, query string")
    meta = bm25(items(spark, root), "item_id", "title", asked, "question", "query", 12).select("question", "item_id", col("score").alias("meta"))
    by_key = bm25(table(spark, root, "documents"), "doc_id", "text", asked, "question", "query", 40)
    keyed = by_key.join(table(spark, root, "documents").select("doc_id", "item_key"), "doc_id").join(items(spark, root).select("item_id", "item_key"), "item_key")
    best = keyed.withColumn("k", F.row_number().over(Window.partitionBy("question", "item_id").orderBy(F.desc("score"), "doc_id"))).where("k <= 2").groupBy("question", "item_id").agg(F.sum("score").alias("full"))
    both = meta.join(best, ["question", "item_id"], "full_outer")
    tier = F.when(col("meta").isNotNull() & col("full").isNotNull(), 0).when(col("full").isNotNull(), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(tier, F.desc(F.when(tier == 1, col("full")).otherwise(col("meta"))), "item_id"))
    return both.withColumn("place", rank).where("place <= 8").select("question", "item_id", tier.alias("tier"), "place")


@_query()
def u1_greedy_dedup(spark, root):
    """Papers kept by a walk in source order that drops whatever repeats a DOI or a title."""
    rank = F.when(col("source") == "pubmed", 0).when(col("source") == "arxiv", 1).otherwise(2)
    p = table(spark, root, "external_papers").select((rank.cast("long") * (1 << 40) + col("paper_id")).alias("pos"), T.normalize_doi("doi").alias("d"), T.normalize_title("title").alias("t"))
    return greedy_dedup(p, "pos", ("d", "t")).select((col("pos") % (1 << 40)).alias("paper_id"))


@_query()
def f6_chunks(spark, root):
    """Chunks of at most 700 characters of every document."""
    return table(spark, root, "documents").where("text <> ''").select("doc_id", F.posexplode(S.chunk_text("text", 700)).alias("chunk", "content"))


@_query("SELECT DISTINCT elem_pk, doc_key, page, left(coalesce(section_name, ''), 60) AS section, length(text) AS chars FROM page_elements WHERE element_type IN ('body', 'abstract_body') AND length(text) >= 20")
def d5_structured_chunks(spark, root):
    """Body elements long enough to be retrieved, with their section."""
    e = table(spark, root, "page_elements").where(col("element_type").isin("body", "abstract_body") & (F.length("text") >= 20))
    return e.select("elem_pk", "doc_key", "page", F.left(T.text("section_name"), F.lit(60)).alias("section"), F.length("text").alias("chars")).distinct()


@_query()
def f19_figure_refs(spark, root):
    """Figures and tables that each element refers to."""
    e = table(spark, root, "page_elements").select("elem_pk", "text").distinct()
    return e.select("elem_pk", F.explode(S.figure_refs("text")).alias("target"))


@_query()
def j11_figure_match(spark, root):
    """References to figures with the first caption of that number in the document, null where there is none."""
    e = table(spark, root, "page_elements").select("elem_pk", "doc_key", "element_type", "text").distinct()
    captions = e.where("element_type = 'figure_caption'").select("doc_key", "elem_pk", S.caption_token("text").alias("target")).where("target is not null").groupBy("doc_key", "target").agg(F.min("elem_pk").alias("caption_pk"))
    refs = e.where("element_type <> 'figure_caption'").select("doc_key", "elem_pk", F.explode(S.figure_refs("text")).alias("target"))
    return refs.join(captions, ["doc_key", "target"], "left").select("elem_pk", "target", "caption_pk")


@_query()
def f21_cliches(spark, root):
    """Spans of machine-made prose in each document."""
    return table(spark, root, "documents").select("doc_id", F.explode(S.cliche_spans("text")).alias("s")).select("doc_id", F.get("s", F.lit(0)).alias("start_at"), F.get("s", F.lit(1)).alias("end_at"))


@_query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def n1_tolerant_json(spark, root):
    """A member of every event's object, which is parsed whatever surrounds it."""
    return table(spark, root, "events").select("event_id", F.get_json_object(S.tolerant_json(F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))), "$.k").cast("long").alias("k"))


@_query()
def x1_text_diff(spark, root):
    """Changes between the titles of a DOI's first and last paper."""
    p = table(spark, root, "external_papers").select("paper_id", "title", T.key(T.normalize_doi("doi")).alias("d")).where("d is not null and title is not null")
    two = p.groupBy("d").agg(F.min_by("title", "paper_id").alias("a"), F.max_by("title", "paper_id").alias("b")).where("a <> b")
    return two.select("d", F.explode(S.text_diff("a", "b")).alias("c")).select(col("d").alias("doi_key"), "c.*")


@_query("""SELECT paper_id, CASE WHEN n = 1 THEN 'baseline' WHEN h = before THEN 'same' ELSE 'changed' END AS verdict FROM (
SELECT paper_id, md5(coalesce(title, '')) AS h, lag(md5(coalesce(title, ''))) OVER w AS before, row_number() OVER w AS n FROM external_papers WHERE url <> '' WINDOW w AS (PARTITION BY url ORDER BY fetched_at, paper_id))""")
def m5_change_detection(spark, root):
    """Whether each check of a page found it changed since the check before; the first is the baseline."""
    w = Window.partitionBy("url").orderBy("fetched_at", "paper_id")
    h = F.md5(T.text("title").cast("binary"))
    p = table(spark, root, "external_papers").where("url <> ''").select("paper_id", h.alias("h"), F.lag(h).over(w).alias("before"), F.row_number().over(w).alias("n"))
    return p.select("paper_id", F.when(col("n") == 1, "baseline").when(col("h") == col("before"), "same").otherwise("changed").alias("verdict"))


@_query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s) SELECT user_id, min(event_id) AS first_event, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM g GROUP BY user_id, g""")
def m10_sessions(spark, root):
    """Sessions that a pause of half an hour ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(col("ts").cast("timestamp"))
    e = table(spark, root, "events").withColumn("at", at).withColumn("new", F.when(col("at") - F.lag("at").over(w) <= 1_800_000_000, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return e.groupBy("user_id", "g").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("us")).drop("g")


@_query("""SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type FROM events) GROUP BY ALL""")
def m_tumbling_windows(spark, root):
    """Events per kind and five minutes."""
    return table(spark, root, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_RIS = "concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || coalesce(title, ''), 'PY  - ' || nullif(pub_year, ''), 'JO  - ' || nullif(journal, ''), 'AB  - ' || nullif(abstract, ''), 'DO  - ' || nullif(doi, ''), 'UR  - ' || nullif(url, ''), 'ID  - ' || nullif(pmid, ''), 'ER  - ')"


@_query()
def k3_ris_blocks(spark, root):
    """Tagged export blocks of all papers."""
    from lectern.sources.exports import ris_block

    return table(spark, root, "external_papers").select("paper_id", ris_block().alias("block"))


@_query(f"SELECT paper_id, {_RIS} AS block FROM external_papers WHERE coalesce(authors, '') = ''")
def k3_ris_without_authors(spark, root):
    """Tagged export blocks of papers without authors, whose tags are the same in SQL."""
    from lectern.sources.exports import ris_block

    return table(spark, root, "external_papers").where(T.text("authors") == "").select("paper_id", ris_block().alias("block"))


@_query("SELECT paper_id, title, coalesce(cited_by, 0) AS cited_by, left(coalesce(abstract, ''), 300) AS digest FROM external_papers WHERE source = 'openalex'")
def k4_digest(spark, root):
    """Rows of a digest: short abstracts, missing counts as none."""
    return table(spark, root, "external_papers").where("source = 'openalex'").select("paper_id", "title", F.coalesce("cited_by", F.lit(0)).alias("cited_by"), F.left(T.text("abstract"), F.lit(300)).alias("digest"))
