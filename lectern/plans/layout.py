"""Queries over page layout, references in texts, contexts and state tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.assignment import greedy_assign
from lectern.operators.hierarchy import latest_links, resolve
from lectern.plans.functions import sql_doi, sql_title
from lectern.plans.hierarchy import _WALK
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


def _elements(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    number = F.regexp_extract("element_id", r"_e(\d+)", 1).cast("int").alias("n")
    return table(spark, root, "page_elements").select("elem_pk", "doc_key", "page", number, *columns).distinct()


def _sql_elements(*columns: str) -> str:
    return f"(SELECT DISTINCT elem_pk, doc_key, page, regexp_extract(element_id, '_e(\\d+)', 1)::INT AS n{''.join(', ' + c for c in columns)} FROM page_elements)"


def _b(i: int, suffix: str = "") -> F.Column:
    return F.get(f"bbox{suffix}", F.lit(i))


# --- collections -------------------------------------------------------------------------------------------------


@_query(f"""WITH RECURSIVE {_WALK}, above AS (SELECT id, unnest(path) AS ancestor_id FROM states)
SELECT DISTINCT i.item_id, a.ancestor_id FROM (SELECT DISTINCT item_id, unnest(collection_ids) AS c FROM zotero_items) i JOIN above a ON i.c = a.id""")
def j5_ancestor_closure(spark, root):
    """Every collection that an item lies in or below."""
    paths = resolve(latest_links(table(spark, root, "zotero_collections"), "collection_id", "parent_id", "synced_at", "coll_name")).select("node", F.explode("path_ids").alias("ancestor_id"))
    own = table(spark, root, "zotero_items").select("item_id", F.explode("collection_ids").alias("node")).distinct()
    return own.join(paths, "node").select("item_id", "ancestor_id").distinct()


@_query(f"SELECT item_id FROM ({ORACLES['j5_ancestor_closure']}) WHERE ancestor_id = 2")
def pred_09_collection_members(spark, root):
    """Items in one collection or below it."""
    return j5_ancestor_closure(spark, root).where("ancestor_id = 2").select("item_id")


# --- layout ------------------------------------------------------------------------------------------------------


@_query()
def j12_caption_figures(spark, root):
    """Each caption with the nearest table of its page or the one before that no earlier caption took."""
    e = _elements(spark, root, "element_type", "bbox").withColumn("x", (_b(0) + _b(2)) / 2).withColumn("y", (_b(1) + _b(3)) / 2)
    captions = e.where("element_type = 'figure_caption'").select("doc_key", col("elem_pk").alias("caption_pk"), col("x").alias("cx"), col("y").alias("cy"), F.explode(F.array("page", col("page") - 1)).alias("page"))
    figures = e.where("element_type = 'table'").select("doc_key", "page", col("elem_pk").alias("figure_pk"), "x", "y")
    pairs = captions.join(figures, ["doc_key", "page"]).withColumn("d", (col("x") - col("cx")) ** 2 + (col("y") - col("cy")) ** 2)
    return greedy_assign(pairs.withColumn("turn", col("caption_pk")), "caption_pk", "turn", "figure_pk", "d")


@_query(f"""SELECT a.elem_pk AS left_pk, b.elem_pk AS right_pk FROM {_sql_elements('bbox')} a JOIN {_sql_elements('bbox')} b ON a.doc_key = b.doc_key AND a.page = b.page AND a.elem_pk < b.elem_pk
WHERE least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2]) > 0.1 * least(a.bbox[4] - a.bbox[2], b.bbox[4] - b.bbox[2])""")
def j14_fragment_pairs(spark, root):
    """Pairs of elements of a page whose bands overlap."""
    e = _elements(spark, root, "bbox")
    a, b = (e.select("doc_key", "page", col("elem_pk").alias(f"pk{s}"), col("bbox").alias(f"bbox{s}")) for s in ("_a", "_b"))
    band = F.least(_b(3, "_a"), _b(3, "_b")) - F.greatest(_b(1, "_a"), _b(1, "_b"))
    low = F.least(_b(3, "_a") - _b(1, "_a"), _b(3, "_b") - _b(1, "_b"))
    return a.join(b, ["doc_key", "page"]).where("pk_a < pk_b").where(band > 0.1 * low).select(col("pk_a").alias("left_pk"), col("pk_b").alias("right_pk"))


@_query(f"SELECT doc_key, page, list_sort(list(font_size))[count(*) // 2 + 1] AS middle_size FROM {_sql_elements('font_size')} WHERE font_size IS NOT NULL GROUP BY doc_key, page")
def j15_middle_font(spark, root):
    """The upper middle font size of each page."""
    w = Window.partitionBy("doc_key", "page")
    e = _elements(spark, root, "font_size").where("font_size is not null").withColumn("k", F.row_number().over(w.orderBy("font_size", "elem_pk"))).withColumn("c", F.count("*").over(w))
    return e.where(col("k") == F.expr("c div 2") + 1).select("doc_key", "page", col("font_size").alias("middle_size"))


@_query(f"""WITH s AS (SELECT *, CASE WHEN bbox[2] - lag(bbox[4]) OVER w <= greatest(14, 0.15 * (bbox[4] - bbox[2])) AND abs(bbox[1] - lag(bbox[1]) OVER w) < 5 THEN 0 ELSE 1 END AS new FROM {_sql_elements('bbox')} WINDOW w AS (PARTITION BY doc_key, page ORDER BY n, elem_pk)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_key, page ORDER BY n, elem_pk) AS block FROM s) SELECT doc_key, page, min(elem_pk) AS first_pk, count(*) AS n_lines FROM g GROUP BY doc_key, page, block""")
def w13_line_blocks(spark, root):
    """Blocks of elements of one column that follow each other closely."""
    w = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk")
    e = _elements(spark, root, "bbox").withColumn("before", F.lag("bbox").over(w))
    near = (_b(1) - F.get("before", F.lit(3)) <= F.greatest(F.lit(14.0), 0.15 * (_b(3) - _b(1)))) & (F.abs(_b(0) - F.get("before", F.lit(0))) < 5)
    g = e.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    return g.groupBy("doc_key", "page", "block").agg(F.min("elem_pk").alias("first_pk"), F.count("*").alias("n_lines")).drop("block")


_OPEN = r"regexp_matches(text, '[a-z,\-]\s*$')"


@_query(f"""WITH s AS (SELECT *, CASE WHEN lag({_OPEN}) OVER w AND regexp_matches(text, '^[a-z]') THEN 0 ELSE 1 END AS new FROM {_sql_elements('text')} WHERE text <> '' WINDOW w AS (PARTITION BY doc_key, page ORDER BY n, elem_pk)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_key, page ORDER BY n, elem_pk) AS p FROM s) SELECT min(elem_pk) AS first_pk, string_agg(text, ' ' ORDER BY n, elem_pk) AS joined FROM g GROUP BY doc_key, page, p HAVING count(*) > 1""")
def w12_stitch_fragments(spark, root):
    """Fragments of a page that go on in the next element, joined."""
    w = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk")
    e = _elements(spark, root, "text").where("text <> ''").withColumn("open", F.lag(col("text").rlike(r"[a-z,\-]\s*$")).over(w))
    g = e.withColumn("new", F.when(col("open") & col("text").rlike("^[a-z]"), 0).otherwise(1)).withColumn("p", F.sum("new").over(w))
    parts = g.groupBy("doc_key", "page", "p").agg(F.array_sort(F.collect_list(F.struct("n", "elem_pk", "text"))).alias("l")).where("size(l) > 1")  # one page's fragments
    return parts.select(F.get("l", F.lit(0))["elem_pk"].alias("first_pk"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("joined"))


@_query("SELECT doc_key, page, count_if(element_type IN ('table', 'figure_caption')) AS figures, count_if(length(coalesce(text, '')) < 60) / count(*) >= 0.75 AND figures >= 2 AS plate FROM (SELECT DISTINCT elem_pk, doc_key, page, element_type, text FROM page_elements) GROUP BY doc_key, page")
def n9_plate_pages(spark, root):
    """Pages of several figures and hardly any text."""
    g = _elements(spark, root, "element_type", "text").groupBy("doc_key", "page").agg(F.count_if(col("element_type").isin("table", "figure_caption")).alias("figures"), (F.count_if(F.length(T.text("text")) < 60) / F.count("*")).alias("short"))
    return g.select("doc_key", "page", "figures", ((col("short") >= 0.75) & (col("figures") >= 2)).alias("plate"))


@_query(f"""SELECT elem_pk, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) / ext < 0.07 OR bbox[4] < 200 AS decorative FROM (SELECT *, max(bbox[3]) OVER (PARTITION BY doc_key, page) * max(bbox[4]) OVER (PARTITION BY doc_key, page) AS ext FROM {_sql_elements('element_type', 'bbox')}) WHERE element_type = 'table'""")
def n10_decorative(spark, root):
    """Tables that are small for their page or stand in its head."""
    w = Window.partitionBy("doc_key", "page")
    e = _elements(spark, root, "element_type", "bbox").withColumn("ext", F.max(_b(2)).over(w) * F.max(_b(3)).over(w)).where("element_type = 'table'")
    return e.select("elem_pk", (((_b(2) - _b(0)) * (_b(3) - _b(1)) / col("ext") < 0.07) | (_b(3) < 200)).alias("decorative"))


@_query(f"""SELECT elem_pk, sum(CASE WHEN element_type = 'subtitle' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, page ORDER BY n, elem_pk ROWS UNBOUNDED PRECEDING) > 0 AND length(coalesce(text, '')) < 80 AS absorbed FROM {_sql_elements('element_type', 'text')}""")
def n11_template_blocks(spark, root):
    """Short elements that follow a heading on their page."""
    w = Window.partitionBy("doc_key", "page").orderBy("n", "elem_pk").rowsBetween(Window.unboundedPreceding, 0)
    e = _elements(spark, root, "element_type", "text").withColumn("h", F.sum((col("element_type") == "subtitle").cast("int")).over(w))
    return e.select("elem_pk", ((F.coalesce("h", F.lit(0)) > 0) & (F.length(T.text("text")) < 80)).alias("absorbed"))


@_query("SELECT elem_pk, CASE WHEN element_type IN ('title', 'subtitle', 'body', 'table', 'equation', 'reference') THEN element_type ELSE 'unknown' END AS kind, greatest(bbox[1], 0) AS x0, greatest(bbox[3], bbox[1]) AS x1, coalesce(nullif(element_id, ''), 'p' || page || '_e0') AS id FROM (SELECT DISTINCT elem_pk, page, element_id, element_type, bbox FROM page_elements)")
def d3_page_normalisation(spark, root):
    """Elements with known types, boxes in order and ids."""
    e = table(spark, root, "page_elements").select("elem_pk", "page", "element_id", "element_type", "bbox").distinct()
    kind = F.when(col("element_type").isin("title", "subtitle", "body", "table", "equation", "reference"), col("element_type")).otherwise("unknown")
    return e.select("elem_pk", kind.alias("kind"), F.greatest(_b(0), F.lit(0.0)).alias("x0"), F.greatest(_b(2), _b(0)).alias("x1"), F.coalesce(T.key(col("element_id")), F.concat(F.lit("p"), "page", F.lit("_e0"))).alias("id"))


@_query("SELECT e.doc_key, e.element_id, max(d.doc_id) AS image_doc FROM (SELECT DISTINCT doc_key, element_id FROM page_elements WHERE element_type = 'table') e LEFT JOIN documents d ON d.item_key = e.doc_key AND d.source = 'caption' GROUP BY 1, 2")
def d4_backfill(spark, root):
    """Tables with the caption document of their item, null where there is none."""
    e = table(spark, root, "page_elements").where("element_type = 'table'").select("doc_key", "element_id").distinct()
    d = table(spark, root, "documents").where("source = 'caption'").groupBy(col("item_key").alias("doc_key")).agg(F.max("doc_id").alias("image_doc"))
    return e.join(d, "doc_key", "left").select("doc_key", "element_id", "image_doc")


# --- predicates and texts ----------------------------------------------------------------------------------------


def _predicate(name: str, doc: str, spark_column: Callable[[], F.Column], sql: str, alias: str) -> None:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return table(spark, root, "page_elements").select("elem_pk", spark_column().alias(alias)).distinct()

    query.__doc__ = doc
    QUERIES[name] = query
    ORACLES[name] = f"SELECT DISTINCT elem_pk, {sql} AS {alias} FROM page_elements"


_t = lambda: T.text("text")
_S = "coalesce(text, '')"
_predicate(
    "f9_strip_watermarks", "Watermarks, soft hyphens, odd spaces and ligatures removed, spaces folded.",
    lambda: F.md5(F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.regexp_replace(_t(), r"(?i)downloaded from \S+( on \w+)?|for personal use only", ""), F.lit("\xad"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), r"[\x{a0}\x{2009}\x{202f}]", " "), r"[ \t\n]+", " ")).cast("binary")),
    rf"md5(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace({_S}, '(?i)downloaded from \S+( on \w+)?|for personal use only', '', 'g'), chr(173), ''), 'ﬁ', 'fi'), '[\x{{a0}}\x{{2009}}\x{{202f}}]', ' ', 'g'), '[ \t\n]+', ' ', 'g')))", "cleaned",
)
_predicate("f10_running_head", "Blank lines and those that begin like a running head.", lambda: (F.trim(_t()) == "") | _t().rlike(r"^(?:©|Page \d|p\. \d|Downloaded from|doi:|ACCEPTED MANUSCRIPT)"), rf"trim({_S}) = '' OR regexp_matches({_S}, '^(?:©|Page \d|p\. \d|Downloaded from|doi:|ACCEPTED MANUSCRIPT)')", "running_head")
_predicate("f11_front_matter", "Front-matter noise of a first page: dates, addresses, identifiers, licences, lines without letters.", lambda: (col("page") == 1) & (_t().rlike(r"(?i)^(received|accepted|published|copyright|correspondence)\b|@|doi\.org|^doi:") | ((F.length(_t()) <= 60) & ~_t().rlike(r"[A-Za-z]"))), rf"page = 1 AND (regexp_matches({_S}, '(?i)^(received|accepted|published|copyright|correspondence)\b|@|doi\.org|^doi:') OR (length({_S}) <= 60 AND NOT regexp_matches({_S}, '[A-Za-z]')))", "front_noise")
_predicate("f12_affiliation", "Blocks that name institutions.", lambda: (col("page") <= 2) & _t().rlike(r"(?i)\b(universit|institut|department|hospital|laborator|school of)") & ~_t().rlike(r"\b(we|was|were)\b"), rf"page <= 2 AND regexp_matches({_S}, '(?i)\b(universit|institut|department|hospital|laborator|school of)') AND NOT regexp_matches({_S}, '\b(we|was|were)\b')", "affiliation")
_predicate("f13_author_line", "Author lines and key-word lines.", lambda: _t().rlike(r"(?i)^(key ?words?|index terms)\b") | ((col("page") == 1) & _t().rlike(r"^[A-Z][\w\-]+, [A-Z]\.( and co-workers|,|$)")), rf"regexp_matches({_S}, '(?i)^(key ?words?|index terms)\b') OR (page = 1 AND regexp_matches({_S}, '^[A-Z][\w\-]+, [A-Z]\.( and co-workers|,|$)'))", "author_line")
_predicate("f14_sentence_end", "Whether a text ends a sentence, abbreviations apart.", lambda: _t().rlike(r"[.!?。！？][\"')\]]*\s*$") & ~_t().rlike(r"\b(et al|Fig|cf|e\.g|i\.e|vs|Dr)\.\s*$"), rf"regexp_matches({_S}, '[.!?。！？][\"'')\]]*\s*$') AND NOT regexp_matches({_S}, '\b(et al|Fig|cf|e\.g|i\.e|vs|Dr)\.\s*$')", "sentence_end")
_predicate("f20_caption_number", "The number that a caption begins with.", lambda: F.regexp_extract(_t(), r"^\s*(?:Figure|Fig\.?|Table)\s*\.?\s*([Ss]?[0-9]{1,3})", 1), rf"regexp_extract({_S}, '^\s*(?:Figure|Fig\.?|Table)\s*\.?\s*([Ss]?[0-9]{{1,3}})', 1)", "caption_no")
_predicate("f22_reference_number", "The number of a reference entry.", lambda: F.when(col("element_type") == "reference", F.regexp_extract(_t(), r"^\s*\[?(\d{1,3})[\].]", 1)), rf"CASE WHEN element_type = 'reference' THEN regexp_extract({_S}, '^\s*\[?(\d{{1,3}})[\].]', 1) END", "ref_no")
_predicate("f23_reference_year", "First year of a reference and its first word as author.", lambda: F.when(col("element_type") == "reference", F.concat_ws(" ", F.regexp_extract(_t(), r"^\W*\d*\W*(\p{L}[\w\-]*)", 1), F.regexp_extract(_t(), r"\b((?:19|20)\d\d)\b", 1))), rf"CASE WHEN element_type = 'reference' THEN concat_ws(' ', regexp_extract({_S}, '^[^\p{{L}}]*(\p{{L}}[\w\-]*)', 1), regexp_extract({_S}, '\b((?:19|20)\d\d)\b', 1)) END", "author_year")
_predicate("f26_author_year_marks", "Number of author-year marks.", lambda: F.size(F.regexp_extract_all(_t(), F.lit(r"([A-Z][a-z]+ et al\.)"), 1)), rf"len(regexp_extract_all({_S}, '[A-Z][a-z]+ et al\.'))", "n_marks")
_predicate("a15_citation_marks", "Distinct citation marks, eight where there are none.", lambda: F.when(F.size(F.array_distinct(F.regexp_extract_all(_t(), F.lit(r"(\[\d{1,3}\])"), 1))) == 0, 8).otherwise(F.size(F.array_distinct(F.regexp_extract_all(_t(), F.lit(r"(\[\d{1,3}\])"), 1)))), rf"CASE WHEN len(list_distinct(regexp_extract_all({_S}, '\[\d{{1,3}}\]'))) = 0 THEN 8 ELSE len(list_distinct(regexp_extract_all({_S}, '\[\d{{1,3}}\]'))) END", "n_cited")


@_query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text <> ''),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\d+(\\.\\d+)* [A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM p)
SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, sum(length(regexp_replace(line, '\\s', '', 'g')))::BIGINT AS chars FROM h GROUP BY doc_id, section""")
def a14_section_statistics(spark, root):
    """Lines and characters of each section of a document; a numbered line begins one."""
    p = table(spark, root, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    h = p.withColumn("section", F.sum(col("line").rlike(r"^\d+(\.\d+)* [A-Z]").cast("int")).over(Window.partitionBy("doc_id").orderBy("k")))
    return h.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length(F.regexp_replace("line", r"\s", ""))).alias("chars"))


@_query("SELECT item_key, string_agg(left(text, 700), chr(10) || '---' || chr(10) ORDER BY doc_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY doc_id) AS k FROM documents WHERE text <> '' AND item_key IS NOT NULL) WHERE k <= 3 GROUP BY item_key")
def d6_context_assembly(spark, root):
    """The evidence block of each item: its first three texts, cut to seven hundred characters."""
    d = table(spark, root, "documents").where("text <> '' and item_key is not null").withColumn("k", F.row_number().over(Window.partitionBy("item_key").orderBy("doc_id"))).where("k <= 3")
    g = d.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("k", F.left("text", F.lit(700)).alias("t")))).alias("l"))  # three texts
    return g.select("item_key", F.array_join(F.transform("l", lambda x: x["t"]), "\n---\n").alias("context"))


_TOPIC = ("seasonal", "tensor", "study")


@_query("SELECT item_id, score FROM (SELECT item_id, " + " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{w}') THEN 20 ELSE 0 END + CASE WHEN contains(lower(concat_ws(' ', title, publication)), '{w}') THEN 5 ELSE 0 END" for w in _TOPIC) + " AS score FROM (SELECT DISTINCT * FROM zotero_items)) WHERE score > 0")
def t6_topic_ranking(spark, root):
    """Items by how many words of a topic stand in their title and elsewhere."""
    title, every = F.lower(T.text("title")), F.lower(F.concat_ws(" ", "title", "publication"))
    score = sum((F.when(F.contains(title, F.lit(w)), 20).otherwise(0) + F.when(F.contains(every, F.lit(w)), 5).otherwise(0) for w in _TOPIC), F.lit(0))
    return items(spark, root).select("item_id", score.alias("score")).where("score > 0")


@_query(r"SELECT DISTINCT regexp_extract(replace(pdf_path, '\', '/'), '^(.*)/[^/]*/[^/]*$', 1) AS folder FROM pdf_texts WHERE pdf_path <> ''")
def t12_folders(spark, root):
    """Distinct library folders."""
    return table(spark, root, "pdf_texts").where("pdf_path <> ''").select(F.regexp_extract(F.replace("pdf_path", F.lit("\\"), F.lit("/")), "^(.*)/[^/]*/[^/]*$", 1).alias("folder")).distinct()


# --- intervals and state -----------------------------------------------------------------------------------------


@_query("""WITH s AS (SELECT l_partkey AS k, l_linenumber * 10 + l_orderkey % 50 AS a, l_linenumber * 10 + l_orderkey % 50 + l_quantity::BIGINT AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(a) AS start_at, max(b) AS end_at FROM g GROUP BY k, g""")
def n7_interval_merge(spark, root):
    """Overlapping spans of each key merged."""
    a = (col("l_linenumber") * 10 + col("l_orderkey") % 50).cast("long")
    w = Window.partitionBy("k").orderBy("a", "b")
    s = table(spark, root, "lineitem").select(col("l_partkey").alias("k"), a.alias("a"), (a + col("l_quantity").cast("long")).alias("b"))
    m = s.withColumn("reached", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = m.withColumn("g", F.sum(F.when(col("reached").isNull() | (col("a") > col("reached")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("k", "g").agg(F.min("a").alias("start_at"), F.max("b").alias("end_at")).drop("g")


@_query("SELECT a.o_orderkey AS comment_id, b.l_linenumber AS span_no FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey WHERE NOT (b.l_shipdate <= a.o_orderdate OR b.l_shipdate > a.o_orderdate + INTERVAL 30 DAY)")
def j21_interval_overlap(spark, root):
    """Spans of a document that a comment's interval meets."""
    o, l = table(spark, root, "orders"), table(spark, root, "lineitem")
    met = o.join(l, col("o_orderkey") == col("l_orderkey")).where((col("l_shipdate") > col("o_orderdate")) & (col("l_shipdate") <= col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    return met.select(col("o_orderkey").alias("comment_id"), col("l_linenumber").alias("span_no"))


@_query("SELECT c_custkey AS seam, coalesce(f.v, p.v) AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) f ON f.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS v FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey WHERE coalesce(f.v, p.v) IS NOT NULL")
def u9_overlay(spark, root):
    """A preliminary map under a final one."""
    o = table(spark, root, "orders")
    final = o.where("o_orderpriority like '1%'").groupBy(col("o_custkey").alias("seam")).agg(F.max("o_orderstatus").alias("v"))
    first = o.groupBy(col("o_custkey").alias("seam")).agg(F.min("o_orderstatus").alias("p"))
    return table(spark, root, "customer").select(col("c_custkey").alias("seam")).join(final, "seam", "left").join(first, "seam", "left").select("seam", F.coalesce("v", "p").alias("state")).where("state is not null")


@_query(f"SELECT DISTINCT {sql_doi('doi')} AS d, {sql_title('title')} AS t FROM external_papers WHERE source = 'pubmed' UNION SELECT DISTINCT {sql_doi('doi')}, {sql_title('title')} FROM zotero_items WHERE item_id % 11 = 0")
def u11_blacklist_add(spark, root):
    """The blacklist after an addition: each pair of keys once."""
    k = lambda t: t.select(T.normalize_doi("doi").alias("d"), T.normalize_title("title").alias("t"))
    return k(table(spark, root, "external_papers").where("source = 'pubmed'")).union(k(table(spark, root, "zotero_items").where("item_id % 11 = 0"))).distinct()


@_query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 200")
def u14_history(spark, root):
    """The newest two hundred rows of each history."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, root, "events").withColumn("k", F.row_number().over(w)).where("k <= 200").select("user_id", "event_id", "ts")


@_query("SELECT item_key, CASE WHEN m.item_key IS NULL THEN 'extract' WHEN d.at > m.at THEN 'refresh' ELSE 'keep' END AS step FROM (SELECT item_key, max(created_at) AS at FROM documents WHERE item_key IS NOT NULL GROUP BY 1) d LEFT JOIN (SELECT doc_key AS item_key, max(parsed_at) AS at FROM page_elements GROUP BY 1) m USING (item_key)".replace("m.item_key IS NULL", "m.at IS NULL"))
def m6_incremental_refresh(spark, root):
    """What an incremental index does with each item: extract, refresh or keep."""
    d = table(spark, root, "documents").where("item_key is not null").groupBy("item_key").agg(F.max("created_at").alias("at"))
    m = table(spark, root, "page_elements").groupBy(col("doc_key").alias("item_key")).agg(F.max("parsed_at").alias("parsed"))
    return d.join(m, "item_key", "left").select("item_key", F.when(col("parsed").isNull(), "extract").when(col("at") > col("parsed"), "refresh").otherwise("keep").alias("step"))
