"""Joins, aggregates, windows, rankings and set operations over the library, papers, events and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.functions import sql_doi, sql_key, sql_title
from lectern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def items(spark: SparkSession, root: str) -> DataFrame:
    """The library's items, repeated rows once."""
    return table(spark, root, "zotero_items").distinct()


_ITEMS = "(SELECT DISTINCT * FROM zotero_items)"
col = F.col

# --- scans and filters -------------------------------------------------------------------------------------------


@_query(f"SELECT i.item_id, c AS collection_id FROM (SELECT DISTINCT item_id, unnest(collection_ids) AS c FROM zotero_items) i WHERE c IN (SELECT collection_id FROM zotero_collections)")
def s4_item_collection_edges(spark, root):
    """Item-collection edges whose collection is known."""
    edges = table(spark, root, "zotero_items").select("item_id", F.explode("collection_ids").alias("collection_id")).distinct()
    return edges.join(table(spark, root, "zotero_collections").select("collection_id"), "collection_id", "left_semi")


@_query(f"SELECT item_id, item_key, row_number() OVER (ORDER BY date_added DESC, item_id) AS newest FROM {_ITEMS} QUALIFY newest <= 200")
def s5_items_newest_first(spark, root):
    """The two hundred newest items with their rank (the top-k of a listing page)."""
    top = items(spark, root).select("item_id", "item_key", "date_added").orderBy(F.desc("date_added"), "item_id").limit(200)
    return top.withColumn("newest", F.row_number().over(Window.orderBy(F.desc("date_added"), "item_id"))).drop("date_added")


@_query(r"SELECT pdf_id, sum(length(trim(full_text))) / max(n_pages) >= 0.15 AS has_text FROM pdf_texts GROUP BY pdf_id")
def s9_text_layer(spark, root):
    """Whether a document's text has at least 0.15 characters per page."""
    return table(spark, root, "pdf_texts").select("pdf_id", (F.length(F.trim("full_text")) / col("n_pages") >= 0.15).alias("has_text"))


@_query("""SELECT DISTINCT p.doc_key, p.page FROM (SELECT DISTINCT doc_key, page FROM page_elements) p
WHERE NOT EXISTS (SELECT 1 FROM page_elements e WHERE e.doc_key = p.doc_key AND e.page = p.page AND length(trim(coalesce(e.text, ''))) >= 400)""")
def s11_pages_without_text(spark, root):
    """Pages none of whose elements has four hundred characters: where a fallback would be read."""
    e = table(spark, root, "page_elements")
    useful = e.where(F.length(F.trim("text")) >= 400).select("doc_key", "page")
    return e.select("doc_key", "page").distinct().join(useful, ["doc_key", "page"], "left_anti")


@_query(f"SELECT item_id, item_type FROM {_ITEMS} WHERE lower(trim(coalesce(item_type, ''))) NOT IN ('attachment', 'note', 'annotation')")
def pred_01_item_types(spark, root):
    """Items that are neither attachments, notes nor annotations."""
    return items(spark, root).where(~F.lower(F.trim(T.text("item_type"))).isin("attachment", "note", "annotation")).select("item_id", "item_type")


@_query(f"SELECT item_id, pdf_path FROM {_ITEMS} WHERE pdf_path ILIKE '%.pdf'")
def pred_02_pdf_attachments(spark, root):
    """Items with a PDF, whatever the case of its ending."""
    return items(spark, root).where(col("pdf_path").ilike("%.pdf")).select("item_id", "pdf_path")


@_query(r"""WITH b AS (SELECT min(y) AS lo, max(y) AS hi FROM (SELECT try_cast(pub_year AS INT) AS y FROM zotero_items) WHERE y BETWEEN 2000 AND 2020)
SELECT paper_id, source FROM external_papers, b WHERE source <> 'arxiv' OR NOT regexp_matches(coalesce(pub_year, ''), '^\d+$') OR try_cast(pub_year AS INT) BETWEEN lo AND hi""")
def pred_06_residual_years(spark, root):
    """For one source only, the years that all bounds together allow; papers without a year stay."""
    bounds = table(spark, root, "zotero_items").select(F.expr("try_cast(pub_year AS int)").alias("y")).where("y between 2000 and 2020").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    y = F.expr("try_cast(pub_year AS int)")
    kept = (col("source") != "arxiv") | ~T.text("pub_year").rlike(r"^\d+$") | y.between(col("lo"), col("hi"))
    return table(spark, root, "external_papers").crossJoin(F.broadcast(bounds)).where(kept).select("paper_id", "source")  # bounds: one row


_BLACK = f"(SELECT {sql_doi('doi')} AS d, {sql_title('title')} AS t FROM zotero_items WHERE item_id % 11 = 0)"


@_query(f"SELECT paper_id FROM external_papers WHERE NOT ({sql_doi('doi')} <> '' AND {sql_doi('doi')} IN (SELECT d FROM {_BLACK})) AND NOT ({sql_title('title')} <> '' AND {sql_title('title')} IN (SELECT t FROM {_BLACK}))")
def pred_07_blacklist(spark, root):
    """Papers that no blacklisted item matches by DOI or by title (the list: every eleventh item)."""
    black = table(spark, root, "zotero_items").where("item_id % 11 = 0").select(T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    papers = table(spark, root, "external_papers").select("paper_id", T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    return papers.join(black.select("d").distinct(), "d", "left_anti").join(black.select("t").distinct(), "t", "left_anti").select("paper_id")


_WORDS = ("lipid", "cortical", "volcanic")


@_query("SELECT paper_id FROM external_papers WHERE " + " OR ".join(f"contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '{w}')" for w in _WORDS))
def pred_08_keywords(spark, root):
    """Papers in whose title or abstract one of the keywords stands, whatever its case."""
    said = F.lower(F.concat_ws(" ", T.text("title"), T.text("abstract")))
    return table(spark, root, "external_papers").where(F.exists(F.array(*map(F.lit, _WORDS)), lambda w: F.contains(said, w))).select("paper_id")


@_query("SELECT paper_id, CASE WHEN source IN ('pubmed', 'arxiv') THEN source ELSE 'pubmed' END AS plan_source, CASE WHEN try_cast(pub_year AS INT) BETWEEN 1900 AND 2100 THEN try_cast(pub_year AS INT) END AS year_from FROM external_papers WHERE trim(coalesce(title, '')) <> ''")
def pred_10_plan_validation(spark, root):
    """Search plans: blank ones dropped, unknown sources replaced, years out of range null."""
    y = F.expr("try_cast(pub_year AS int)")
    return table(spark, root, "external_papers").where(F.trim(T.text("title")) != "").select("paper_id", F.when(col("source").isin("pubmed", "arxiv"), col("source")).otherwise("pubmed").alias("plan_source"), F.when(y.between(1900, 2100), y).alias("year_from"))


@_query("SELECT paper_id FROM (SELECT paper_id, source, row_number() OVER (PARTITION BY source ORDER BY paper_id) AS pos FROM external_papers) WHERE pos NOT IN (SELECT supp FROM (SELECT s_suppkey AS supp FROM supplier))")
def pred_11_off_topic_positions(spark, root):
    """Results whose 1-based position per source was not called off topic (positions from the supplier keys)."""
    ranked = table(spark, root, "external_papers").withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("paper_id")).cast("long"))
    return ranked.join(table(spark, root, "supplier").select(col("s_suppkey").alias("pos")), "pos", "left_anti").select("paper_id")


@_query("SELECT c_custkey AS topic_id FROM (SELECT c_custkey, max(o_orderdate) AS last_run FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) WHERE last_run IS NULL OR last_run <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def pred_15_due(spark, root):
    """Topics that never ran or whose last run lies ninety days before the newest one."""
    last = table(spark, root, "orders").groupBy(col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("last_run"))
    now = table(spark, root, "orders").agg(F.max("o_orderdate").alias("now"))
    runs = table(spark, root, "customer").join(last, col("c_custkey") == col("k"), "left").crossJoin(F.broadcast(now))  # one row
    return runs.where(col("last_run").isNull() | (col("last_run") <= col("now") - F.expr("INTERVAL 90 DAYS"))).select(col("c_custkey").alias("topic_id"))


@_query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 60 SECOND")
def pred_16_cooldown(spark, root):
    """Checks that come sixty seconds or more after the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, root, "events").withColumn("before", F.lag("ts").over(w))
    return e.where(col("before").isNull() | (col("ts") - F.expr("INTERVAL 60 SECONDS") >= col("before"))).select("event_id")


# --- joins -------------------------------------------------------------------------------------------------------


@_query(f"""WITH n AS (SELECT item_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS k FROM {_ITEMS})
SELECT item_id, string_agg(trim(a), '; ' ORDER BY k) AS author_line, count(*) AS n_authors FROM n GROUP BY item_id""")
def j2_author_lists(spark, root):
    """Ordered author list of each item from its (item, order, name) rows."""
    rows = items(spark, root).select("item_id", F.posexplode("authors").alias("k", "a"))
    g = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", F.trim("a").alias("a")))).alias("l"))  # one item's authors
    return g.select("item_id", F.array_join(F.transform("l", lambda x: x["a"]), "; ").alias("author_line"), F.size("l").cast("long").alias("n_authors"))


@_query(f"""SELECT item_id, field, min(v) AS value FROM (SELECT item_id, unnest(['title', 'doi', 'publication']) AS field, unnest([title, doi, publication]) AS v FROM {_ITEMS}) WHERE v <> '' GROUP BY item_id, field""")
def j1_attribute_values(spark, root):
    """Item attributes as (item, field, value) rows, the least value where there are several."""
    e = items(spark, root).select("item_id", F.explode(F.create_map(*(x for f in ("title", "doi", "publication") for x in (F.lit(f), col(f))))).alias("field", "v"))
    return e.where("v <> ''").groupBy("item_id", "field").agg(F.min("v").alias("value"))


@_query(f"SELECT item_id, max(CASE WHEN field = 'title' THEN value END) AS title, max(CASE WHEN field = 'doi' THEN value END) AS doi FROM ({ORACLES['j1_attribute_values']}) GROUP BY item_id")
def j1_attribute_pivot(spark, root):
    """The attribute rows pivoted to one row per item."""
    return j1_attribute_values(spark, root).where("field in ('title', 'doi')").groupBy("item_id").pivot("field", ["title", "doi"]).agg(F.min("value")).join(
        j1_attribute_values(spark, root).select("item_id").distinct(), "item_id", "right"
    )


@_query("""WITH c AS (SELECT pdf_path, pdf_id, CASE WHEN pdf_path LIKE 'C:/Zotero/storage/%' THEN 0 WHEN pdf_path LIKE '/home/%' THEN 1 ELSE 2 END AS rank FROM pdf_texts)
SELECT i.item_id, c.pdf_id FROM (SELECT DISTINCT item_id, pdf_path FROM zotero_items WHERE pdf_path <> '') i JOIN c USING (pdf_path) QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY rank, c.pdf_id) = 1""")
def j3_attachment_precedence(spark, root):
    """The first attachment of each item by the precedence of its place."""
    path = col("pdf_path")
    c = table(spark, root, "pdf_texts").select("pdf_path", "pdf_id", F.when(path.startswith("C:/Zotero/storage/"), 0).when(path.startswith("/home/"), 1).otherwise(2).alias("rank"))
    i = table(spark, root, "zotero_items").where("pdf_path <> ''").select("item_id", "pdf_path").distinct()
    best = i.join(c, "pdf_path").groupBy("item_id").agg(F.min(F.struct("rank", "pdf_id")).alias("b"))
    return best.select("item_id", col("b.pdf_id").alias("pdf_id"))


@_query("SELECT collection_id FROM (SELECT DISTINCT collection_id, parent_id FROM zotero_collections) WHERE parent_id IS NULL OR parent_id NOT IN (SELECT collection_id FROM zotero_collections WHERE collection_id IS NOT NULL)")
def j4_roots(spark, root):
    """Collections, by any of their rows, whose parent is null or unknown."""
    c = table(spark, root, "zotero_collections").select("collection_id", "parent_id").distinct()
    known = c.select(col("collection_id").alias("parent_id")).where("parent_id is not null").distinct()
    return c.join(known, "parent_id", "left_anti").select("collection_id")


_POOL = f"(SELECT item_id, {sql_doi('doi')} AS d, {sql_title('title')} AS t FROM {_ITEMS})"


@_query(f"""WITH pool AS {_POOL}, bd AS (SELECT d, min(item_id) AS hit FROM pool WHERE d <> '' GROUP BY d), bt AS (SELECT t, min(item_id) AS hit FROM pool WHERE t <> '' GROUP BY t)
SELECT paper_id, coalesce(bd.hit, bt.hit) AS item_id FROM external_papers p LEFT JOIN bd ON {sql_doi('p.doi')} = bd.d LEFT JOIN bt ON {sql_title('p.title')} = bt.t WHERE coalesce(bd.hit, bt.hit) IS NOT NULL""")
def j6_library_match(spark, root):
    """The first library item with a paper's DOI, failing that with its title."""
    pool = items(spark, root).select("item_id", T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    by_doi = pool.where("d is not null").groupBy("d").agg(F.min("item_id").alias("hit_d"))
    by_title = pool.where("t is not null").groupBy("t").agg(F.min("item_id").alias("hit_t"))
    p = table(spark, root, "external_papers").select("paper_id", T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    return p.join(by_doi, "d", "left").join(by_title, "t", "left").select("paper_id", F.coalesce("hit_d", "hit_t").alias("item_id")).where("item_id is not null")


@_query(f"SELECT paper_id, EXISTS (SELECT 1 FROM {_POOL} z WHERE z.d <> '' AND z.d = {sql_doi('p.doi')}) OR EXISTS (SELECT 1 FROM {_POOL} z WHERE z.t <> '' AND z.t = {sql_title('p.title')}) AS in_library FROM external_papers p")
def j7_in_library_flag(spark, root):
    """All papers with a flag for those that the library has."""
    have = j6_library_match(spark, root).select("paper_id", F.lit(True).alias("hit"))
    return table(spark, root, "external_papers").select("paper_id").join(have, "paper_id", "left").select("paper_id", F.coalesce("hit", F.lit(False)).alias("in_library"))


_SURNAME = "lower(trim(string_split(coalesce(authors[1], ''), ',')[1]))"


@_query(f"""WITH z AS (SELECT item_id, pub_year AS y, {_SURNAME} AS s FROM {_ITEMS} WHERE len(authors) > 0 AND pub_year <> ''),
p AS (SELECT paper_id, pub_year AS y, lower(trim(string_split(coalesce(authors, ''), ',')[1])) AS s FROM external_papers WHERE authors <> '' AND pub_year <> '')
SELECT paper_id, item_id FROM p JOIN z USING (y) WHERE p.s <> '' AND z.s <> '' AND (contains(p.s, z.s) OR contains(z.s, p.s))""")
def j8_citation_match(spark, root):
    """Items of a citation's year whose first author's name contains the cited one or is contained in it."""
    z = items(spark, root).where("size(authors) > 0 and pub_year <> ''").select("item_id", col("pub_year").alias("y"), F.lower(F.trim(F.get(F.split(F.get("authors", F.lit(0)), ","), F.lit(0)))).alias("sz")).where("sz <> ''")
    p = table(spark, root, "external_papers").where("authors <> '' and pub_year <> ''").select("paper_id", col("pub_year").alias("y"), F.lower(F.trim(F.get(F.split("authors", ","), F.lit(0)))).alias("sp")).where("sp <> ''")
    return p.join(z, "y").where(F.contains("sp", col("sz")) | F.contains("sz", col("sp"))).select("paper_id", "item_id")


@_query(f"""SELECT coalesce(nullif(source, ''), '?') AS source, count(*) AS n, count_if({sql_title('title')} IN (SELECT t FROM {_POOL} WHERE t <> '')) AS known,
CASE WHEN known = 0 THEN 'none' WHEN known = n THEN 'all' ELSE 'some' END AS verdict FROM external_papers GROUP BY 1""")
def j10_known_papers(spark, root):
    """Of each source's papers, how many titles the library knows."""
    pool = items(spark, root).select(T.key(T.normalize_title("title")).alias("t")).where("t is not null").distinct().withColumn("hit", F.lit(1))
    p = table(spark, root, "external_papers").select(F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source"), T.normalize_title("title").alias("t")).join(pool, "t", "left")
    g = p.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("known"))
    return g.withColumn("verdict", F.when(col("known") == 0, "none").when(col("known") == col("n"), "all").otherwise("some"))


_ONE_E = "(SELECT DISTINCT elem_pk, doc_key, page, element_id, element_type, bbox, text FROM page_elements)"


@_query(f"""SELECT a.elem_pk AS figure_pk, b.elem_pk AS inner_pk FROM {_ONE_E} a JOIN {_ONE_E} b ON a.doc_key = b.doc_key AND a.page = b.page AND a.elem_pk <> b.elem_pk
WHERE a.element_type = 'table' AND greatest(0, least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1])) * greatest(0, least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2])) >= 0.02 * (b.bbox[3] - b.bbox[1]) * (b.bbox[4] - b.bbox[2])""")
def j13_containment(spark, root):
    """Elements of a table's page that overlap it by part of their own area."""
    e = table(spark, root, "page_elements").select("elem_pk", "doc_key", "page", "element_type", "bbox").distinct()
    b = lambda s, i: F.get(f"bbox_{s}", F.lit(i))
    x, y = (e.select("doc_key", "page", *(col(c).alias(f"{c}_{s}") for c in ("elem_pk", "element_type", "bbox"))) for s in "ab")
    over = F.greatest(F.lit(0.0), F.least(b("a", 2), b("b", 2)) - F.greatest(b("a", 0), b("b", 0))) * F.greatest(F.lit(0.0), F.least(b("a", 3), b("b", 3)) - F.greatest(b("a", 1), b("b", 1)))
    met = x.where("element_type_a = 'table'").join(y, ["doc_key", "page"]).where("elem_pk_a <> elem_pk_b")
    return met.where(over >= 0.02 * (b("b", 2) - b("b", 0)) * (b("b", 3) - b("b", 1))).select(col("elem_pk_a").alias("figure_pk"), col("elem_pk_b").alias("inner_pk"))


@_query(f"""WITH e AS (SELECT doc_key, page, max_by(elem_pk, elem_pk) AS last_pk, min_by(elem_pk, elem_pk) AS first_pk FROM {_ONE_E} WHERE element_type = 'body' GROUP BY doc_key, page),
n AS (SELECT *, lead(page) OVER w AS next_page, lead(first_pk) OVER w AS next_pk FROM e WINDOW w AS (PARTITION BY doc_key ORDER BY page)) SELECT doc_key, page, last_pk, next_pk FROM n WHERE next_page - page <= 2""")
def j16_page_seams(spark, root):
    """Last body element of a page beside the first of the next one that has any, at most two pages on."""
    e = table(spark, root, "page_elements").where("element_type = 'body'").groupBy("doc_key", "page").agg(F.max("elem_pk").alias("last_pk"), F.min("elem_pk").alias("first_pk"))
    nxt = [e.select("doc_key", (col("page") - d).alias("page"), col("first_pk").alias(f"n{d}")) for d in (1, 2)]
    j = e.join(nxt[0], ["doc_key", "page"], "left").join(nxt[1], ["doc_key", "page"], "left")
    return j.select("doc_key", "page", "last_pk", F.coalesce("n1", "n2").alias("next_pk")).where("next_pk is not null")


_SNAP = "SELECT collection_id AS id, {f}(synced_at) AS at, arg_{f}(coalesce(parent_id, -1), synced_at) AS parent FROM zotero_collections GROUP BY collection_id"


@_query("""WITH o AS (SELECT collection_id AS id, min(coalesce(parent_id, -1)) AS p FROM zotero_collections WHERE collection_id % 7 <> 0 GROUP BY 1), n AS (SELECT collection_id AS id, max(coalesce(parent_id, -1)) AS p FROM zotero_collections WHERE collection_id % 5 <> 0 GROUP BY 1)
SELECT count_if(o.id IS NULL) AS added, count_if(n.id IS NULL) AS removed, count_if(o.p <> n.p) AS modified FROM o FULL JOIN n ON o.id = n.id""")
def j17_snapshot_diff(spark, root):
    """Counts of added, removed and modified collections between two snapshots."""
    c = table(spark, root, "zotero_collections").withColumn("p", F.coalesce("parent_id", F.lit(-1)))
    old = c.where("collection_id % 7 <> 0").groupBy(col("collection_id").alias("o_id")).agg(F.min("p").alias("o_p"))
    new = c.where("collection_id % 5 <> 0").groupBy(col("collection_id").alias("n_id")).agg(F.max("p").alias("n_p"))
    d = old.join(new, col("o_id") == col("n_id"), "full_outer")
    return d.agg(F.count_if(col("o_id").isNull()).alias("added"), F.count_if(col("n_id").isNull()).alias("removed"), F.count_if(col("o_p") != col("n_p")).alias("modified"))


@_query("SELECT DISTINCT l_partkey AS link FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def j18_new_links(spark, root):
    """Links of one snapshot that the one before did not have."""
    l = table(spark, root, "lineitem")
    return l.where("l_returnflag = 'R'").select(col("l_partkey").alias("link")).distinct().join(l.where("l_returnflag = 'A'").select(col("l_partkey").alias("link")), "link", "left_anti")


@_query("""WITH seeds AS (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 5000), edges AS (SELECT l_suppkey AS s, l_partkey AS w, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_suppkey, l_orderkey, 0 FROM lineitem WHERE l_linestatus = 'F')
SELECT w AS work, count(*) AS links FROM edges WHERE s IN (SELECT s FROM seeds) AND w NOT IN (SELECT s FROM seeds) GROUP BY w ORDER BY links DESC, w LIMIT 50""")
def j19_citation_graph(spark, root):
    """The fifty works most linked with the seeds, over related and citing edges, seeds left out."""
    l = table(spark, root, "lineitem")
    seeds = table(spark, root, "supplier").where("s_acctbal > 5000").select(col("s_suppkey").alias("s"))
    edges = l.where("l_linenumber <= 3").select(col("l_suppkey").alias("s"), col("l_partkey").alias("work")).unionByName(l.where("l_linestatus = 'F'").select(col("l_suppkey").alias("s"), col("l_orderkey").alias("work")))
    found = edges.join(seeds, "s", "left_semi").groupBy("work").agg(F.count("*").alias("links"))
    return found.join(seeds.select(col("s").alias("work")), "work", "left_anti").orderBy(F.desc("links"), "work").limit(50)


@_query(f"""SELECT item_id, coalesce((SELECT min(paper_id) FROM external_papers p WHERE {sql_doi('z.doi')} <> '' AND {sql_doi('p.doi')} = {sql_doi('z.doi')}), (SELECT min(paper_id) FROM external_papers p WHERE {sql_title('z.title')} <> '' AND {sql_title('p.title')} = {sql_title('z.title')})) AS work FROM {_ITEMS} z""")
def j20_seed_resolution(spark, root):
    """Every seed with the work its DOI or else its title leads to, or null."""
    p = table(spark, root, "external_papers").select("paper_id", T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    by = {k: p.where(f"{k} is not null").groupBy(k).agg(F.min("paper_id").alias(f"hit_{k}")) for k in "dt"}
    z = items(spark, root).select("item_id", T.key(T.normalize_doi("doi")).alias("d"), T.key(T.normalize_title("title")).alias("t"))
    return z.join(by["d"], "d", "left").join(by["t"], "t", "left").select("item_id", F.coalesce("hit_d", "hit_t").alias("work"))


# --- aggregates --------------------------------------------------------------------------------------------------


@_query(f"SELECT lower(trim(coalesce(item_type, ''))) AS kind, count(*) AS n FROM {_ITEMS} GROUP BY 1")
def a1_item_types(spark, root):
    """Items by type."""
    return items(spark, root).groupBy(F.lower(F.trim(T.text("item_type"))).alias("kind")).agg(F.count("*").alias("n"))


@_query("SELECT ts::DATE AS day, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def a2_daily_counters(spark, root):
    """Events per day and kind."""
    return table(spark, root, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@_query("SELECT ts::DATE AS day, max(value) AS top_value FROM events GROUP BY 1")
def a3_daily_max(spark, root):
    """The greatest value of each day."""
    return table(spark, root, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("top_value"))


@_query("SELECT ts::DATE AS day, count(DISTINCT user_id) AS readers FROM events GROUP BY 1")
def a4_distinct_per_day(spark, root):
    """Distinct readers per day."""
    return table(spark, root, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("readers"))


_SESSIONS = "SELECT user_id, event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events"


@_query(f"SELECT event_id, ceil(us / 60000000.0)::BIGINT AS minutes FROM ({_SESSIONS}) WHERE us >= 1000000")
def a5_session_minutes(spark, root):
    """Minutes of each session, begun ones counted whole; sessions below a second are none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(col("ts").cast("timestamp"))
    return table(spark, root, "events").withColumn("us", us).where("us >= 1000000").select("event_id", F.ceil(col("us") / 60000000.0).alias("minutes"))


@_query("""WITH b AS (SELECT max(ts)::DATE AS d FROM events), days AS (SELECT unnest(generate_series(d - INTERVAL 29 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM b)
SELECT day, coalesce(n, 0) AS n FROM days LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) USING (day)""")
def a6_zero_filled(spark, root):
    """The last thirty days, those without events as zero."""
    e = table(spark, root, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = table(spark, root, "events").agg(F.to_date(F.max("ts")).alias("d")).select(F.explode(F.sequence(F.date_sub("d", 29), col("d"))).alias("day"))
    return days.join(e, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@_query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d)
SELECT user_id, max(n) AS longest, max_by(n, last) AS current FROM (SELECT user_id, count(*) AS n, max(day) AS last FROM g GROUP BY user_id, island) GROUP BY user_id""")
def a7_streaks(spark, root):
    """Longest and latest run of consecutive days of each user."""
    d = table(spark, root, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = d.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    runs = g.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"))


@_query("SELECT o_orderpriority AS scope, count_if(o_orderstatus = 'F') AS done, count(*) AS total, count_if(o_orderstatus = 'F') * 100 // count(*) AS percent FROM orders GROUP BY 1")
def a8_completion(spark, root):
    """Done and total per scope with the percent cut down to a whole number."""
    g = table(spark, root, "orders").groupBy(col("o_orderpriority").alias("scope")).agg(F.count_if(col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    return g.withColumn("percent", F.expr("done * 100 div total"))


@_query("SELECT day FROM (SELECT DISTINCT ts::DATE AS day FROM events) ORDER BY day DESC LIMIT 20")
def a9_newest_days(spark, root):
    """The twenty newest days."""
    return table(spark, root, "events").select(F.to_date("ts").alias("day")).distinct().orderBy(F.desc("day")).limit(20)


@_query("SELECT coalesce(source, '') AS source, count(*) AS n FROM external_papers GROUP BY 1")
def a10_source_counts(spark, root):
    """Papers by source."""
    return table(spark, root, "external_papers").groupBy(T.text("source").alias("source")).agg(F.count("*").alias("n"))


@_query("SELECT user_id, sum(value) AS best_two, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2 GROUP BY user_id")
def a11_best_two(spark, root):
    """Sum of each item's two best hits."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, root, "events").withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("user_id").agg(F.sum("value").alias("best_two"), F.count("*").alias("hits"))


@_query("""SELECT item_key, count(*) AS n, round(avg(n_chars)) AS mean_chars, sort_array[n // 2 + 1] AS median_chars, sort_array[n // 4 + 1] AS q1, sort_array[3 * n // 4 + 1] AS q3
FROM (SELECT item_key, n_chars, count(*) OVER (PARTITION BY item_key) AS n, list_sort(list(n_chars) OVER (PARTITION BY item_key)) AS sort_array FROM documents WHERE item_key IS NOT NULL) GROUP BY ALL""".replace("count(*) AS n, round", "n, round"))
def a13_index_quartiles(spark, root):
    """Count, mean, middle and quarters of a group's sorted values by index, not by interpolation."""
    w = Window.partitionBy("item_key")
    r = table(spark, root, "documents").where("item_key is not null").select("item_key", "n_chars", F.row_number().over(w.orderBy("n_chars", "doc_id")).alias("k"), F.count("*").over(w).alias("n"), F.round(F.avg("n_chars").over(w)).alias("mean_chars"))
    at = lambda e, name: F.max(F.when(col("k") == F.expr(e) + 1, col("n_chars"))).alias(name)
    return r.groupBy("item_key", "n", "mean_chars").agg(at("n div 2", "median_chars"), at("n div 4", "q1"), at("3 * n div 4", "q3"))


@_query("SELECT element_type, count(*) AS n, max(len(string_split_regex(trim(coalesce(text, '')), '\\s+'))) AS most_words, count_if(length(text) > 1800) AS oversized FROM page_elements GROUP BY 1")
def a16_parse_quality(spark, root):
    """Elements by type, with the longest in words and the oversized."""
    words = F.size(F.split(F.trim(T.text("text")), r"\s+"))
    return table(spark, root, "page_elements").groupBy("element_type").agg(F.count("*").alias("n"), F.max(words).alias("most_words"), F.count_if(F.length("text") > 1800).alias("oversized"))


@_query("SELECT doc_key, max(page) AS pages, count(DISTINCT page) AS parsed, count(DISTINCT page) / max(page) AS part FROM page_elements GROUP BY doc_key")
def a17_manifest(spark, root):
    """Pages parsed of each document."""
    return table(spark, root, "page_elements").groupBy("doc_key").agg(F.max("page").alias("pages"), F.countDistinct("page").alias("parsed"), (F.countDistinct("page") / F.max("page")).alias("part"))


@_query("SELECT item_key, sum(n_chars)::BIGINT AS bytes, count(*) AS files, bool_or(source = 'draft') AS has_draft FROM documents GROUP BY item_key")
def a18_sizes(spark, root):
    """Sizes and kinds of what belongs to each item."""
    return table(spark, root, "documents").groupBy("item_key").agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("files"), F.bool_or(col("source") == "draft").alias("has_draft"))


@_query("SELECT min(try_cast(pub_year AS INT)) AS year_lo, max(try_cast(pub_year AS INT)) AS year_hi FROM external_papers")
def a20_year_envelope(spark, root):
    """Least and greatest year of all papers that have one."""
    y = F.expr("try_cast(pub_year AS int)")
    return table(spark, root, "external_papers").agg(F.min(y).alias("year_lo"), F.max(y).alias("year_hi"))


# --- windows -----------------------------------------------------------------------------------------------------


@_query(f"SELECT min(paper_id) AS paper_id, {sql_title('title')} AS t FROM external_papers WHERE {sql_title('title')} <> '' GROUP BY 2")
def w1_first_per_key(spark, root):
    """The first paper of each title."""
    return table(spark, root, "external_papers").select("paper_id", T.key(T.normalize_title("title")).alias("t")).where("t is not null").groupBy("t").agg(F.min("paper_id").alias("paper_id"))


_READ = "(SELECT DISTINCT elem_pk, doc_key, page, regexp_extract(element_id, '_e(\\d+)', 1)::INT AS n, element_type, text FROM page_elements)"


@_query(f"SELECT elem_pk, last_value(CASE WHEN element_type = 'subtitle' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY page, n, elem_pk ROWS UNBOUNDED PRECEDING) AS section FROM {_READ}")
def w2_forward_fill(spark, root):
    """The heading under which each element stands.

    Filled in two steps, so that a document of any length is never one task: within the page, then from the
    last heading of the pages before.
    """
    e = table(spark, root, "page_elements").select("elem_pk", "doc_key", "page", F.regexp_extract("element_id", r"_e(\d+)", 1).cast("int").alias("n"), F.when(col("element_type") == "subtitle", col("text")).alias("h")).distinct()
    w = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk").rowsBetween(Window.unboundedPreceding, 0)
    inside = e.withColumn("own", F.last("h", True).over(w))
    pages = e.groupBy("doc_key", "page").agg(F.max_by("h", F.when(col("h").isNotNull(), F.struct("n", "elem_pk"))).alias("last_h"))
    before = pages.withColumn("carried", F.last("last_h", True).over(Window.partitionBy("doc_key").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before.select("doc_key", "page", "carried"), ["doc_key", "page"]).select("elem_pk", F.coalesce("own", "carried").alias("section"))


@_query(f"SELECT elem_pk, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY doc_key, page ORDER BY n, elem_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM {_READ}")
def w3_running_offset(spark, root):
    """Offset of each element in its page's text."""
    e = table(spark, root, "page_elements").select("elem_pk", "doc_key", "page", F.regexp_extract("element_id", r"_e(\d+)", 1).cast("int").alias("n"), F.length(T.text("text")).alias("l")).distinct()
    w = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("elem_pk", F.coalesce(F.sum(col("l") + 1).over(w), F.lit(0)).alias("start_at"))


@_query("SELECT elem_pk, 'p' || page || '_e' || row_number() OVER (PARTITION BY doc_key, page ORDER BY elem_pk) AS new_id FROM (SELECT DISTINCT elem_pk, doc_key, page FROM page_elements)")
def w4_page_counter(spark, root):
    """Element ids counted anew on each page."""
    e = table(spark, root, "page_elements").select("elem_pk", "doc_key", "page").distinct()
    k = F.row_number().over(Window.partitionBy("doc_key", "page").orderBy("elem_pk"))
    return e.select("elem_pk", F.concat(F.lit("p"), "page", F.lit("_e"), k).alias("new_id"))


@_query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars // 4) OVER (PARTITION BY item_key ORDER BY created_at DESC, doc_id DESC) AS used FROM documents WHERE item_key IS NOT NULL) WHERE used <= 2000")
def w5_budgeted_suffix(spark, root):
    """The newest documents of each item that fit a budget together."""
    w = Window.partitionBy("item_key").orderBy(F.desc("created_at"), F.desc("doc_id"))
    d = table(spark, root, "documents").where("item_key is not null").withColumn("used", F.sum(F.expr("n_chars div 4")).over(w))
    return d.where("used <= 2000").select("doc_id")


@_query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6")
def w6_last_six(spark, root):
    """The last six messages of each conversation."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, root, "events").withColumn("k", F.row_number().over(w)).where("k <= 6").select("event_id")


@_query("SELECT user_id, n, CASE WHEN n <= 0 THEN 0 WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 6 THEN 3 ELSE 4 END AS heat FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def w8_heat_levels(spark, root):
    """Heat level of each user's activity."""
    g = table(spark, root, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    n = col("n")
    return g.withColumn("heat", F.when(n <= 0, 0).when(n <= 1, 1).when(n <= 3, 2).when(n <= 6, 3).otherwise(4))


@_query("SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS above, lead(o_orderkey) OVER w AS below FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey)")
def w10_neighbours(spark, root):
    """The neighbours with which a plan of the same date could change places."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return table(spark, root, "orders").select(col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("above"), F.lead("o_orderkey").over(w).alias("below"))


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(item_key, '') ORDER BY created_at DESC, doc_id DESC) AS k FROM documents) WHERE k <= 20")
def w14_retention(spark, root):
    """The twenty newest backups of each document."""
    w = Window.partitionBy(T.text("item_key")).orderBy(F.desc("created_at"), F.desc("doc_id"))
    return table(spark, root, "documents").withColumn("k", F.row_number().over(w)).where("k <= 20").select("doc_id")


# --- ranking -----------------------------------------------------------------------------------------------------


@_query(r"""WITH y AS (SELECT paper_id, CASE WHEN regexp_matches(coalesce(pub_year, ''), '^\d+$') THEN pub_year::INT END AS y, greatest(coalesce(cited_by, 0), 0) AS c FROM external_papers), b AS (SELECT min(y) AS lo, max(y) AS hi, max(c) AS mc FROM y)
SELECT paper_id, round(0.7 * CASE WHEN y IS NULL THEN 0.5 ELSE (y - lo) / greatest(hi - lo, 1) END + 0.3 * CASE WHEN mc > 0 THEN ln(1 + c) / ln(1 + mc) ELSE 0 END, 6) AS score FROM y, b""")
def t4_weighted_rank(spark, root):
    """Score of each paper by year and by citations."""
    y = F.when(T.text("pub_year").rlike(r"^\d+$"), F.expr("try_cast(pub_year AS int)"))
    p = table(spark, root, "external_papers").select("paper_id", y.alias("y"), F.greatest(F.coalesce("cited_by", F.lit(0)), F.lit(0)).alias("c"))
    b = p.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("c").alias("mc"))
    ys = F.when(col("y").isNull(), 0.5).otherwise((col("y") - col("lo")) / F.greatest(col("hi") - col("lo"), F.lit(1)))
    cs = F.when(col("mc") > 0, F.log1p("c") / F.log1p("mc")).otherwise(0.0)
    return p.crossJoin(F.broadcast(b)).select("paper_id", F.round(0.7 * ys + 0.3 * cs, 6).alias("score"))  # one row


_Q = "vascular"


@_query(f"""WITH s AS (SELECT item_id, lower(coalesce(title, '')) AS t, authors, coalesce(pub_year, '') AS y, lower(coalesce(doi, '')) AS d, concat_ws(' ', lower(coalesce(title, '')), {_SURNAME}, coalesce(pub_year, ''), lower(coalesce(publication, '')), lower(coalesce(doi, ''))) AS a FROM {_ITEMS}),
x AS (SELECT item_id, CASE WHEN contains(t, '{_Q}') THEN 100 ELSE 0 END + CASE WHEN t = '{_Q}' THEN 200 ELSE 0 END + CASE WHEN len(list_filter(authors, lambda n: contains(lower(n), '{_Q}'))) > 0 THEN 50 ELSE 0 END + CASE WHEN y = '{_Q}' THEN 30 ELSE 0 END + CASE WHEN contains(d, '{_Q}') THEN 80 ELSE 0 END + 5 * (length(a) - length(replace(a, '{_Q}', ''))) // {len(_Q)} AS score FROM s)
SELECT item_id, score FROM x WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10""")
def t5_library_search(spark, root):
    """The ten items that a search word fits best, weighted by field."""
    t, d = F.lower(T.text("title")), F.lower(T.text("doi"))
    surname = F.lower(F.trim(F.get(F.split(T.text(F.get("authors", F.lit(0))), ","), F.lit(0))))
    every = F.concat_ws(" ", t, surname, T.text("pub_year"), F.lower(T.text("publication")), d)
    hit = lambda c, w: F.when(c, w).otherwise(0)
    has_author = F.coalesce(F.exists("authors", lambda n: F.contains(F.lower(n), F.lit(_Q))), F.lit(False))
    score = hit(F.contains(t, F.lit(_Q)), 100) + hit(t == _Q, 200) + hit(has_author, 50) + hit(T.text("pub_year") == _Q, 30) + hit(F.contains(d, F.lit(_Q)), 80) + 5 * T.occurrences(every, _Q)
    return items(spark, root).select("item_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "item_id").limit(10)


@_query("SELECT user_id AS paper, sum(value) AS minutes FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t7_top_papers(spark, root):
    """The ten most read."""
    return table(spark, root, "events").groupBy(col("user_id").alias("paper")).agg(F.sum("value").alias("minutes")).orderBy(F.desc("minutes"), "paper").limit(10)


@_query(f"SELECT item_id FROM (SELECT DISTINCT item_id, {sql_doi('doi')} = '' AS bare FROM zotero_items) ORDER BY bare, item_id LIMIT 50")
def t8_seed_list(spark, root):
    """Fifty seeds, those with a DOI first."""
    z = table(spark, root, "zotero_items").select("item_id", (T.normalize_doi("doi") == "").alias("bare")).distinct()
    return z.orderBy("bare", "item_id").limit(50).select("item_id")


@_query(f"SELECT doc_key, max_by(text, length(text) * 100000000 - elem_pk) AS title FROM {_READ} WHERE page = 1 AND length(text) BETWEEN 12 AND 300 AND element_type IN ('title', 'subtitle') GROUP BY doc_key")
def t10_title_candidates(spark, root):
    """The likeliest title of each document: the longest heading of its first page."""
    e = table(spark, root, "page_elements").where((col("page") == 1) & F.length("text").between(12, 300) & col("element_type").isin("title", "subtitle"))
    return e.groupBy("doc_key").agg(F.max_by("text", F.struct(F.length("text"), -col("elem_pk"))).alias("title"))


# --- set operations and upserts ----------------------------------------------------------------------------------


@_query("SELECT source, paper_id, row_number() OVER (ORDER BY CASE source WHEN 'pubmed' THEN 0 WHEN 'arxiv' THEN 1 ELSE 2 END, paper_id) AS pos FROM external_papers QUALIFY pos <= 500")
def u3_union_of_sources(spark, root):
    """The first five hundred results in the fixed order of the sources."""
    p = table(spark, root, "external_papers").select("source", "paper_id")
    rank = F.when(col("source") == "pubmed", 0).when(col("source") == "arxiv", 1).otherwise(2)
    top = p.orderBy(rank, "paper_id").limit(500)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(rank, "paper_id")))


@_query("SELECT pdf_path, max_by(item_id, date_added) AS item_id FROM (SELECT DISTINCT * FROM zotero_items) WHERE pdf_path <> '' GROUP BY 1")
def u7_latest_wins(spark, root):
    """Of the entries of one path the latest."""
    return items(spark, root).where("pdf_path <> ''").groupBy("pdf_path").agg(F.max_by("item_id", "date_added").alias("item_id"))


@_query("SELECT c_custkey AS id, c_name AS name, coalesce(last_run, DATE '1970-01-01') AS last_run FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS last_run FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def u10_keep_run_state(spark, root):
    """Configuration rows written anew that keep their run state."""
    state = table(spark, root, "orders").groupBy(col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("run"))
    return table(spark, root, "customer").select(col("c_custkey").alias("id"), col("c_name").alias("name")).join(state, "id", "left").select("id", "name", F.coalesce("run", F.lit("1970-01-01").cast("date")).alias("last_run"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def u13_cascade_delete(spark, root):
    """Dependent rows left when some parents are deleted."""
    gone = table(spark, root, "part").where("p_size < 5").select(col("p_partkey").alias("l_partkey"))
    return table(spark, root, "lineitem").join(gone, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@_query("SELECT user_id, max_by(event_type, ts) AS state FROM events GROUP BY user_id")
def u15_latest_mark(spark, root):
    """The latest mark of each key."""
    return table(spark, root, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"))


@_query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u16_intersect(spark, root):
    """Keys found on both sides."""
    o = table(spark, root, "orders")
    return o.where("o_orderstatus = 'F'").select(col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
