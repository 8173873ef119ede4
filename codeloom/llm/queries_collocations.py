"""Query op13 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language of all documents; null texts are empty, a null language is und, repeated rows count each."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_collocations": op13_collocations}
SQL: dict[str, str] = {
    "op13_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
    SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
), placed AS (
    SELECT lang, pid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM listed
), rows4 AS (
    SELECT lang, x, lead(x, 1) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(x, 3) OVER p AS x4 FROM placed WINDOW p AS (PARTITION BY pid ORDER BY i)
), grams AS (
    SELECT lang, 1 AS k, [x] AS g, count(*) AS f FROM rows4 GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 2, [x, x2], count(*) FROM rows4 WHERE x2 IS NOT NULL GROUP BY lang, x, x2 HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, [x, x2, x3], count(*) FROM rows4 WHERE x3 IS NOT NULL GROUP BY lang, x, x2, x3 HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, [x, x2, x3, x4], count(*) FROM rows4 WHERE x4 IS NOT NULL GROUP BY lang, x, x2, x3, x4 HAVING count(*) >= 30
), phrases AS (
    SELECT lang, k, g, f AS a FROM grams WHERE k > 1
), cuts AS (
    SELECT p.lang, p.k, p.g, p.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a // (x.f::HUGEINT + y.f))::BIGINT AS score
    FROM phrases p, range(1, 4) AS c(cut), grams x, grams y
    WHERE c.cut < p.k AND x.lang = p.lang AND y.lang = p.lang AND x.g = p.g[1 : c.cut] AND y.g = p.g[c.cut + 1 : p.k]
), weakest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS weak FROM cuts
), inside AS (
    SELECT lang, g[s : s + j - 1] AS g, max(a) AS holder
    FROM phrases, range(2, 4) AS js(j), range(1, 4) AS ss(s) WHERE j < k AND s + j - 1 <= k GROUP BY ALL
), kept AS (
    SELECT w.lang, array_to_string(w.g, ' ') AS phrase, w.a, w.l, w.r, w.score
    FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g
    WHERE w.weak = 1 AND (i.holder IS NULL OR 100::HUGEINT * i.holder < 80::HUGEINT * w.a)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
}
