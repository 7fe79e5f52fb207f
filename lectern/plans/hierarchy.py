"""Queries over the collection tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.hierarchy import descendants, latest_links, resolve
from lectern.session import stored, table


def _resolved(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "zotero_collections")
    return resolve(latest_links(rows, "collection_id", "parent_id", "synced_at", "coll_name"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Every collection with its root, depth and state."""
    return _resolved(spark, root).select(F.col("node").alias("collection_id"), F.col("root").alias("root_id"), "depth", "state")


def p4_paths(spark: SparkSession, root: str) -> DataFrame:
    """The path of each collection, as ids and as names (blank or missing names by their id)."""
    named = F.zip_with("path_labels", "path_ids", lambda n, i: F.when(F.trim(n) != "", n).otherwise(F.concat(F.lit("#"), i.cast("string"))))
    return _resolved(spark, root).select(
        F.col("node").alias("collection_id"),
        F.array_join(F.transform("path_ids", lambda i: i.cast("string")), ">").alias("id_path"),
        F.array_join(F.transform(named, lambda n: F.replace(n, F.lit("/"), F.lit("\\/"))), "/").alias("name_path"),
    )


def p4_descendants(spark: SparkSession, root: str) -> DataFrame:
    """Every proper descendant of every collection, with the steps between."""
    pairs = descendants(stored(_resolved(spark, root)))
    return pairs.select(F.col("node").alias("collection_id"), F.col("descendant").alias("descendant_id"), "steps")


_WALK = """
latest AS (
  SELECT collection_id, parent_id, coll_name FROM (
    SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY synced_at DESC NULLS LAST, parent_id ASC NULLS LAST, coll_name ASC NULLS LAST) AS n
    FROM zotero_collections WHERE collection_id IS NOT NULL) WHERE n = 1),
links AS (
  SELECT a.collection_id AS id, b.collection_id AS up, a.coll_name AS label
  FROM latest a LEFT JOIN latest b ON a.parent_id = b.collection_id),
walk AS (
  SELECT id, id AS top, 0::BIGINT AS depth, [id] AS seen, false AS closed FROM links
  UNION ALL
  SELECT w.id, l.up, w.depth + 1, list_append(w.seen, l.up), list_contains(w.seen, l.up)
  FROM walk w JOIN links l ON w.top = l.id WHERE l.up IS NOT NULL AND NOT w.closed),
ends AS (
  SELECT id, top, seen, closed, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS n FROM walk),
states AS (
  SELECT id, CASE WHEN NOT closed THEN top ELSE list_min(list_slice(seen, list_position(seen, top), len(seen))) END AS root,
    CASE WHEN NOT closed THEN len(seen) - 1 ELSE list_position(seen, top) - 1 END AS depth,
    CASE WHEN NOT closed THEN 'tree' WHEN top = id THEN 'cycle' ELSE 'below_cycle' END AS state,
    list_reverse(CASE WHEN NOT closed THEN seen ELSE list_slice(seen, 1, list_position(seen, top)) END) AS path
  FROM ends WHERE n = 1)
"""

P4_FOUND_SQL = f"WITH RECURSIVE {_WALK} SELECT id AS collection_id, root AS root_id, depth::BIGINT AS depth, state FROM states"
P4_PATHS_SQL = f"""WITH RECURSIVE {_WALK},
steps AS (SELECT id, unnest(path) AS node, generate_subscripts(path, 1) AS pos FROM states)
SELECT s.id AS collection_id, string_agg(s.node::VARCHAR, '>' ORDER BY s.pos) AS id_path,
  string_agg(replace(CASE WHEN trim(l.label) <> '' THEN l.label ELSE '#' || s.node END, '/', '\\/'), '/' ORDER BY s.pos) AS name_path
FROM steps s JOIN links l ON s.node = l.id GROUP BY s.id"""
P4_DESCENDANTS_SQL = f"""WITH RECURSIVE {_WALK},
steps AS (SELECT id, unnest(path) AS node, generate_subscripts(path, 1) AS pos, len(path) AS n FROM states)
SELECT node AS collection_id, id AS descendant_id, (n - pos)::BIGINT AS steps FROM steps WHERE pos < n"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}
ORACLES = {"p4_found": P4_FOUND_SQL, "p4_paths": P4_PATHS_SQL, "p4_descendants": P4_DESCENDANTS_SQL}
