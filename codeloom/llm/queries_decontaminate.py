"""Query op1 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items they are of; n_near and near_sha256 count displaced matches too.

    A null or empty text has no words; repeated rows give a row each; empty tables give no rows, or rows without hits.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.sha2(F.array_join(F.array_sort("near_items"), ","), 256).alias("near_sha256"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, s, s + least(10, len(w)) - 1) AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
),
grams AS (
    SELECT doc_id, s, size, list_slice(w, s, s + size - 1) AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
),
found AS (SELECT doc_id, s, g.size, item_id FROM grams g JOIN windows i ON g.win = i.win AND g.size = i.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
),
placed AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
places AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, w FROM placed),
seconds AS (SELECT r, p, w[p] AS head, unnest(list_distinct(list_slice(w, greatest(p - 1, 1), p + 3))) AS second FROM places),
starts AS (
    SELECT DISTINCT r, p, win, size, item_id FROM seconds s JOIN windows i ON s.head = i.win[1] AND s.second = i.win[2] WHERE size > 1
    UNION ALL SELECT r, p, win, size, item_id FROM places s JOIN windows i ON s.w[p] = i.win[1] WHERE size = 1
),
near AS (
    SELECT r, string_agg(item_id, ',' ORDER BY item_id) AS near_ids, count(*) AS n_near
    FROM (
        SELECT DISTINCT r, item_id FROM starts JOIN placed USING (r)
        WHERE len(list_filter(range(1, size), lambda k: NOT list_contains(list_slice(w, greatest(p + k - 2, 1), greatest(p + k + 2, 0)), win[k + 1]))) = 0
    ) GROUP BY r
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM placed d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (r)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL = {"op1_decontaminate": OP1_SQL}
