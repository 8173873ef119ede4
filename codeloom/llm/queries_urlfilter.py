"""Query op10 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .urlfilter import judged

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; a null url has neither host nor path and is allowed. Repeated pages give a row each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP10_SQL = rf"""
WITH rules(rh, rp, rv) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
parts AS (
    SELECT page_id, r, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
),
fits AS (
    SELECT r, rh || rp AS rule, rv, row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
    FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.r = fits.r AND k = 1
"""

QUERIES = {"op10_urlfilter": op10_urlfilter}
SQL = {"op10_urlfilter": OP10_SQL}
