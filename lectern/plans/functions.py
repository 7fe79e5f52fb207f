"""Queries of the scalar functions, one per function of the inventory (its number in the name)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, source: str, keys: tuple[str, ...], columns: Callable[[], dict[str, Column]], sql: str | None) -> None:
    """A query that adds columns to every row of a table; ``sql`` has the columns' expressions."""

    def query(spark: SparkSession, root: str) -> DataFrame:
        return table(spark, root, source).select(*keys, *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"SELECT {', '.join(keys)}, {sql} FROM {source}"


_C = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"


def sql_doi(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '^(https?://(dx\.)?doi\.org/|doi:\s*|info:doi/)', ''), '/+$', '')"


def sql_title(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[^{_C}a-z0-9]', '', 'g')"


def sql_key(doi: str = "doi", pmid: str = "pmid", arxiv: str = "arxiv_id", title: str = "title") -> str:
    return (
        f"CASE WHEN {sql_doi(doi)} <> '' THEN 'doi:' || {sql_doi(doi)} WHEN trim(coalesce({pmid}, '')) <> '' THEN 'pmid:' || trim({pmid}) "
        f"WHEN trim(coalesce({arxiv}, '')) <> '' THEN 'arxiv:' || trim({arxiv}) WHEN {sql_title(title)} <> '' THEN 'title:' || {sql_title(title)} ELSE '' END"
    )


P = "external_papers"
Z = "zotero_items"
col = F.col
_add("f1_normalize_doi", P, ("paper_id",), lambda: {"doi_key": T.normalize_doi("doi")}, f"{sql_doi('doi')} AS doi_key")
_add("f2_normalize_title", P, ("paper_id",), lambda: {"title_key": T.normalize_title("title")}, f"{sql_title('title')} AS title_key")
_add("f3_normalize_journal", P, ("paper_id",), lambda: {"journal_key": T.normalize_journal("journal")}, r"trim(regexp_replace(lower(coalesce(journal, '')), '\s+', ' ', 'g')) AS journal_key")
_add("u2_identity_key", P, ("paper_id",), lambda: {"identity": T.paper_key(col("doi"), col("pmid"), col("arxiv_id"), col("title"))}, f"{sql_key()} AS identity")
_add("pred_03_year_extraction", P, ("paper_id",), lambda: {"year4": T.year_of("pub_year")}, r"regexp_extract(coalesce(pub_year, ''), '(\d{4})', 1) AS year4")
_add(
    "pred_04_default_title", Z, ("item_id",), lambda: {"shown_title": F.when(F.trim(T.text("title")) == "", F.concat(F.lit("Untitled "), "item_key")).otherwise(col("title"))},
    "CASE WHEN trim(coalesce(title, '')) = '' THEN 'Untitled ' || item_key ELSE title END AS shown_title",
)
_add("pred_05_year_range", P, ("paper_id",), lambda: {"allowed": ~T.text("pub_year").rlike(r"^\d+$") | F.expr("try_cast(pub_year AS int)").between(2005, 2015)}, r"NOT regexp_matches(coalesce(pub_year, ''), '^\d+$') OR coalesce(try_cast(pub_year AS INT) BETWEEN 2005 AND 2015, false) AS allowed")
_add("pred_12_url", P, ("paper_id",), lambda: {"valid_url": T.is_url("url")}, r"regexp_matches(coalesce(url, ''), '^https?://\S+$') AS valid_url")
_add(
    "pred_13_profile_name", "zotero_collections", ("collection_id", "synced_at"), lambda: {"usable": T.is_profile_name("coll_name")},
    r"""coalesce(coll_name <> '' AND trim(coll_name) = coll_name AND NOT regexp_matches(coll_name, '[\\/:*?"<>|\x00-\x1f]') AND NOT suffix(coll_name, '.')
    AND NOT regexp_matches(coll_name, '^(?i)(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$') AND length(coll_name) <= 80, false) AS usable""",
)
_add(
    "pred_14_safe_path", "pdf_texts", ("pdf_id",), lambda: {"safe": T.is_safe_path("pdf_path")},
    r"coalesce(pdf_path <> '' AND len(list_filter(string_split(replace(pdf_path, '\', '/'), '/'), lambda p: p IN ('', '.', '..') OR contains(p, ':'))) = 0, false) AS safe",
)
_add("pred_18_english", "documents", ("doc_id",), lambda: {"english": T.english_share("text") > 0.5}, r"CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0.5 ELSE false END AS english")
_add(
    "f4_tokenize", P, ("paper_id",), lambda: {"n_tokens": F.size(T.tokens("title")), "token_line": F.array_join(T.tokens("title"), " ")},
    r"""len(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9\-_]+')) AS n_tokens, array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9\-_]+'), ' ') AS token_line""",
)
_add(
    "f5_split_paragraphs", "documents", ("doc_id",), lambda: {"n_paragraphs": F.size(T.split_paragraphs("text", 40)), "longest": F.coalesce(F.array_max(F.transform(T.split_paragraphs("text", 40), F.length)), F.lit(0))},
    r"""len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[\s\x0b]*\n'), lambda p: trim(p, ' ')), lambda p: length(p) >= 40)) AS n_paragraphs,
    coalesce(list_max(list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[\s\x0b]*\n'), lambda p: trim(p, ' ')), lambda p: length(p) >= 40), lambda p: length(p))), 0) AS longest""",
)
_add(
    "f7_estimate_tokens", "documents", ("doc_id",), lambda: {"est_tokens": T.estimate_tokens("text")},
    r"(length(regexp_replace(coalesce(text, ''), '[\x{0}-\x{2e7f}]', '', 'g')) + (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\x{0}-\x{2e7f}]', '', 'g')) + 3) // 4)::BIGINT AS est_tokens",
)
_add(
    "f8_truncate", "documents", ("doc_id",), lambda: {"short": F.md5(T.truncate_text("text", 300, "\n[...]\n").cast("binary")), "short_chars": F.length(T.truncate_text("text", 300, "\n[...]\n"))},
    r"""md5(CASE WHEN length(coalesce(text, '')) <= 600 THEN coalesce(text, '') ELSE substr(text, 1, 420) || chr(10) || '[...]' || chr(10) || right(text, 180) END) AS short,
    length(CASE WHEN length(coalesce(text, '')) <= 600 THEN coalesce(text, '') ELSE substr(text, 1, 420) || chr(10) || '[...]' || chr(10) || right(text, 180) END) AS short_chars""",
)
_add(
    "f16_cite_key", Z, ("item_id", "synced_at"), lambda: {"cite_key": F.concat_ws(", ", T.key(F.lower(F.trim(F.get(F.split(T.text(F.get("authors", F.lit(0))), ","), F.lit(0))))), T.key(T.text("pub_year")))},
    "concat_ws(', ', nullif(lower(trim(string_split(coalesce(authors[1], ''), ',')[1])), ''), nullif(coalesce(pub_year, ''), '')) AS cite_key",
)
_add("f18_citation_key", "page_elements", ("elem_pk",), lambda: {"cite_numbers": T.citation_key(F.regexp_extract(T.text("text"), r"^(\[[0-9,\- ]+\])", 1))}, r"""CASE WHEN regexp_matches(coalesce(text, ''), '^\[ *[0-9]{1,3}(\s*[,\-]\s*[0-9]{1,3}){0,8} *\]') AND length(regexp_extract(text, '^(\[[0-9,\- ]+\])', 1)) <= 20
    AND regexp_matches(regexp_extract(text, '^(\[[0-9,\- ]+\])', 1), '^\[([0-9]{1,3}(?:\s*[,\-]\s*[0-9]{1,3}){0,8})\]$')
    THEN regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, '^(\[[0-9,\- ]+\])', 1), '[\[\] ]', '', 'g'), '^0+([0-9])', '\1'), '([,\-])0+([0-9])', '\1\2', 'g') END AS cite_numbers""")
_add("f29_ris_authors", P, ("paper_id",), lambda: {"ris": F.array_join(T.ris_authors("authors"), "|")}, r"""array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda p: trim(p)), lambda p: p <> '' AND rtrim(lower(p), '.') <> 'et al'),
    lambda p: CASE WHEN len(string_split_regex(p, '\s+')) >= 2 THEN string_split_regex(p, '\s+')[1] || ', ' || CASE WHEN len(list_filter(string_split_regex(p, '\s+')[2:], lambda t: length(t) <> 1)) = 0
      THEN array_to_string(list_transform(string_split_regex(p, '\s+')[2:], lambda t: t || '.'), ' ') ELSE array_to_string(string_split_regex(p, '\s+')[2:], ' ') END ELSE p END), '|') AS ris""")
_add(
    "f30_human_size", "documents", ("doc_id",), lambda: {"shown": T.human_size(F.length(T.text("text")) * 700)},
    """CASE WHEN length(coalesce(text, '')) * 700 < 1024 THEN printf('%.0f B', length(coalesce(text, '')) * 700.0) WHEN length(text) * 700 < 1048576 THEN printf('%.1f KB', length(text) * 700 / 1024.0)
    WHEN length(text) * 700 < 1073741824 THEN printf('%.1f MB', length(text) * 700 / 1048576.0) ELSE printf('%.1f GB', length(text) * 700 / 1073741824.0) END AS shown""",
)
_add("f31_ids", "pdf_texts", ("pdf_id",), lambda: {"path_md5": F.md5(T.text("pdf_path").cast("binary")), "doc_id12": F.substr(F.md5(F.lower(F.replace(T.text("pdf_path"), F.lit("\\"), F.lit("/"))).cast("binary")), F.lit(1), F.lit(12)), "text_hash": F.sha2(T.text("full_text"), 256)}, r"md5(coalesce(pdf_path, '')) AS path_md5, substr(md5(lower(replace(coalesce(pdf_path, ''), '\', '/'))), 1, 12) AS doc_id12, sha256(coalesce(full_text, '')) AS text_hash")
_add(
    "f32_pubmed_query", P, ("paper_id",),
    lambda: {"rendered": F.concat_ws(" AND ", F.concat(F.lit("("), T.text("title"), F.lit(")")), F.when(F.expr("try_cast(pub_year AS int)").isNotNull(), F.concat(F.expr("try_cast(pub_year AS int)").cast("string"), F.lit(":3000[dp]"))), F.when(col("source") == "pubmed", "review[pt]").when(col("source") == "arxiv", "NOT review[pt]"))},
    "concat_ws(' AND ', '(' || coalesce(title, '') || ')', try_cast(pub_year AS INT)::VARCHAR || ':3000[dp]', CASE source WHEN 'pubmed' THEN 'review[pt]' WHEN 'arxiv' THEN 'NOT review[pt]' END) AS rendered",
)
_add("f33_redact", P, ("paper_id",), lambda: {"logged": F.regexp_replace(F.concat(T.text("url"), F.lit("?api_key="), T.text("pmid"), F.lit("&x=1")), r"(api_key=)[^&\s]*", "$1***")}, r"regexp_replace(coalesce(url, '') || '?api_key=' || coalesce(pmid, '') || '&x=1', '(api_key=)[^&\s]*', '\1***', 'g') AS logged")
_add("f34_preview", P, ("paper_id",), lambda: {"preview": F.when(F.length(T.text("abstract")) > 300, F.concat(F.left("abstract", F.lit(300)), F.lit("…"))).otherwise(T.text("abstract"))}, "CASE WHEN length(coalesce(abstract, '')) > 300 THEN left(abstract, 300) || '…' ELSE coalesce(abstract, '') END AS preview")
_add("f35_web_query", P, ("paper_id",), lambda: {"query_string": F.concat(F.lit("q="), F.url_encode(F.array_join(F.slice(F.split(T.text("title"), " "), 1, 3), " OR ")))}, "'q=' || replace(url_encode(array_to_string(string_split(coalesce(title, ''), ' ')[1:3], ' OR ')), '%20', '+') AS query_string")
_add("t9_natural_order", "page_elements", ("elem_pk",), lambda: {"nat_key": T.natural_key("element_id")}, r"array_to_string(list_transform(regexp_extract_all(lower(element_id), '\d+|[^\d]+'), lambda p: CASE WHEN regexp_matches(p, '^\d+$') THEN lpad(p, 12, '0') ELSE p END), '') AS nat_key")
_add("t11_versions", "documents", ("doc_id",), lambda: {"version_key": F.array_join(T.version_numbers(F.concat(F.lit("v"), (col("doc_id") % 7).cast("string"), F.lit("."), (col("doc_id") % 13).cast("string"))).cast("array<string>"), ".")}, "(doc_id % 7)::VARCHAR || '.' || (doc_id % 13)::VARCHAR || '.0.0.0.0' AS version_key")
_add("n4_geometry", "page_elements", ("elem_pk",), lambda: {"area": (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) * (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))), "centre_x": (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2, "centre_y": (F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))) / 2}, "(bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) AS area, (bbox[1] + bbox[3]) / 2 AS centre_x, (bbox[2] + bbox[4]) / 2 AS centre_y")
_add("n5_pixels", "page_elements", ("elem_pk",), lambda: {f"px{i}": F.floor((F.get("bbox", F.lit(i)) if i % 2 == 0 else 842 - F.get("bbox", F.lit(4 - i))) * 150 / 72).cast("long") for i in range(4)}, "floor(bbox[1] * 150 / 72)::BIGINT AS px0, floor((842 - bbox[4]) * 150 / 72)::BIGINT AS px1, floor(bbox[3] * 150 / 72)::BIGINT AS px2, floor((842 - bbox[2]) * 150 / 72)::BIGINT AS px3")
_add("n8_iso_parse", P, ("paper_id",), lambda: {"parsed": F.try_to_timestamp(F.concat(T.text("pub_year"), F.lit("-03-01T10:00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("date").cast("string")}, r"CASE WHEN regexp_matches(coalesce(pub_year, ''), '^\d{4}$') THEN pub_year || '-03-01' END AS parsed")
_add("w7_heatmap_cell", "events", ("event_id",), lambda: {"week_row": ((F.weekday(F.to_date("ts")) + 1) % 7).cast("int")}, "dayofweek(ts)::INT AS week_row")
_add("w9_calendar_keys", "events", ("event_id",), lambda: {"day_key": F.date_format("ts", "yyyy-MM-dd"), "week_key": F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"), "month_key": F.date_format("ts", "yyyy-MM")}, "strftime(ts, '%Y-%m-%d') AS day_key, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_key, strftime(ts, '%Y-%m') AS month_key")
