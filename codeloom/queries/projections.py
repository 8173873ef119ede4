"""The driver's tables as property graphs, each once as DataFrames and once as SQL from the same expressions.

Supply graph: regions are projects, nations subsystems, suppliers files and parts functions; lineitems are ``supplies`` edges
with parallel duplicates, some targets given by label and some dangling. Trade graph: who contains, places and includes what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.graph import Graph

NODE_COLUMNS = ("id", "label", "kind", "file", "description", "community", "layer", "source_name", "source_id", "organization", "ord")

_PLACE = "'suppliers/' || lower(replace(n_name, ' ', '_')) || '/' || s_name || '.go'"
_PART_FILE = "'packages/' || lower(replace(p_brand, '#', '')) || '/src/' || replace(p_name, ' ', '_') || '.ts'"

# (tables, columns of NODE_COLUMNS, condition)
_NODES = [
    ("region", ["'project:' || r_name", "r_name", "'project'", "''", "''", "r_regionkey", "'repo'", "r_name", "r_name", "'tpc'", "CAST(r_regionkey AS BIGINT)"], None),
    ("nation region", ["r_name || ':subsystem:' || n_name", "n_name", "'subsystem'", "''", "'nation of ' || r_name", "n_regionkey", "'repo'", "r_name", "r_name", "'tpc'", "CAST(100 + n_nationkey AS BIGINT)"], None),
    ("supplier nation region", [f"r_name || ':file:' || {_PLACE}", _PLACE, "'file'", _PLACE, "''", "n_regionkey", "'repo'", "r_name", "r_name", "'tpc'", "CAST(1000 + s_suppkey AS BIGINT)"], None),
    ("part", ["'catalog:part:' || CAST(p_partkey AS STRING)", "p_name", "'function'", _PART_FILE, "lower(p_type)", "CAST(p_size % 5 AS INT)", "'repo'", "'catalog'", "''", "'tpc'", "CAST(10000000 + p_partkey AS BIGINT)"], None),
]

EDGE_COLUMNS = ("src", "dst", "relation", "confidence", "score", "file", "projected_from", "ord")

_CONFIDENCE = "CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'R' THEN 'inferred' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'DECLARED' ELSE '' END END"
_TARGET = "CASE WHEN l_partkey % 97 = 0 THEN 'missing:' || CAST(l_partkey AS STRING) WHEN l_linenumber = 5 THEN p_name ELSE 'catalog:part:' || CAST(l_partkey AS STRING) END"

_EDGES = [
    ("nation region", ["'project:' || r_name", "r_name || ':subsystem:' || n_name", "'contains'", "''", "CAST(0 AS DOUBLE)", "''", "''", "CAST(n_nationkey AS BIGINT)"], None),
    ("supplier nation region", ["r_name || ':subsystem:' || n_name", f"r_name || ':file:' || {_PLACE}", "'contains'", "''", "CAST(0 AS DOUBLE)", _PLACE, "''", "CAST(1000 + s_suppkey AS BIGINT)"], None),
    ("lineitem part supplier nation region", [f"r_name || ':file:' || {_PLACE}", _TARGET, "'supplies'", _CONFIDENCE, "l_discount", _PLACE, "CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'static_import' ELSE '' END", "1000000 + l_orderkey * 10 + l_linenumber"], None),
]

# repeated and empty nodes, and a self edge for each project, for the cleaning operators
_MORE_NODES = [
    ("part", ["'catalog:part:' || CAST(p_partkey AS STRING)", "'again ' || p_name", "'function'", "''", "''", "0", "'repo'", "'catalog'", "''", "'tpc'", "CAST(20000000 + p_partkey AS BIGINT)"], "p_partkey % 50 = 0"),
    ("part", ["''", "p_name", "'function'", "''", "''", "0", "'repo'", "''", "''", "''", "CAST(30000000 + p_partkey AS BIGINT)"], "p_partkey % 60 = 0"),
]
_MORE_EDGES = [
    ("region", ["'project:' || r_name", "'project:' || r_name", "'references'", "'EXTRACTED'", "CAST(0 AS DOUBLE)", "''", "''", "CAST(900000 + r_regionkey AS BIGINT)"], None),
    ("region", ["'ghost:' || r_name", "'project:' || r_name", "'references'", "'EXTRACTED'", "CAST(0 AS DOUBLE)", "''", "''", "CAST(910000 + r_regionkey AS BIGINT)"], None),
    ("region", ["''", "'project:' || r_name", "'references'", "'EXTRACTED'", "CAST(0 AS DOUBLE)", "''", "''", "CAST(920000 + r_regionkey AS BIGINT)"], None),
]

_TRADE = [
    ("nation region", ["'region:' || r_name", "'nation:' || n_name", "'contains'", "CAST(n_nationkey AS BIGINT)"], None),
    ("supplier nation", ["'nation:' || n_name", "'supplier:' || CAST(s_suppkey AS STRING)", "'contains'", "CAST(1000 + s_suppkey AS BIGINT)"], None),
    ("supplier nation", ["'supplier:' || CAST(s_suppkey AS STRING)", "'nation:' || n_name", "'based_in'", "CAST(500000 + s_suppkey AS BIGINT)"], None),
    ("customer nation", ["'nation:' || n_name", "'customer:' || CAST(c_custkey AS STRING)", "'contains'", "CAST(1000000 + c_custkey AS BIGINT)"], None),
    ("orders", ["'customer:' || CAST(o_custkey AS STRING)", "'order:' || CAST(o_orderkey AS STRING)", "'places'", "10000000 + o_orderkey"], None),
    ("lineitem", ["'order:' || CAST(l_orderkey AS STRING)", "'part:' || CAST(l_partkey AS STRING)", "'includes'", "100000000 + l_orderkey * 10 + l_linenumber"], None),
]
TRADE_COLUMNS = ("src", "dst", "relation", "ord")

_KEYS = {
    ("nation", "region"): "n_regionkey = r_regionkey",
    ("supplier", "nation"): "s_nationkey = n_nationkey",
    ("customer", "nation"): "c_nationkey = n_nationkey",
    ("lineitem", "part"): "l_partkey = p_partkey",
    ("lineitem", "supplier"): "l_suppkey = s_suppkey",
}


def _joined(tables: list[str]) -> list[tuple[str, str]]:
    """(table, condition) of each table after the first."""
    return [(t, next(c for (a, b), c in _KEYS.items() if b == t and a in tables)) for t in tables[1:]]


def _sql(parts: list, columns: tuple[str, ...]) -> str:
    out = []
    for tables, exprs, where in parts:
        names = tables.split()
        source = names[0] + "".join(f" JOIN {t} ON {c}" for t, c in _joined(names))
        out.append(f"SELECT {', '.join(f'{e} AS {c}' for e, c in zip(exprs, columns, strict=True))} FROM {source}" + (f" WHERE {where}" if where else ""))
    return " UNION ALL ".join(out)


def _frame(spark: SparkSession, sf_dir: str, parts: list, columns: tuple[str, ...]) -> DataFrame:
    from pyspark.sql import functions as F

    out = None
    for tables, exprs, where in parts:
        names = tables.split()
        df = spark.read.parquet(f"{sf_dir}/{names[0]}.parquet")
        for t, c in _joined(names):
            df = df.join(spark.read.parquet(f"{sf_dir}/{t}.parquet"), F.expr(c))
        df = df.where(where) if where else df
        df = df.selectExpr(*[f"{e} AS {c}" for e, c in zip(exprs, columns, strict=True)])
        out = df if out is None else out.unionByName(df)
    return out


def supply(spark: SparkSession, sf_dir: str, raw: bool = False) -> Graph:
    """The supply graph; ``raw``: with repeated, empty and dangling rows added."""
    return Graph(_frame(spark, sf_dir, _NODES + _MORE_NODES * raw, NODE_COLUMNS), _frame(spark, sf_dir, _EDGES + _MORE_EDGES * raw, EDGE_COLUMNS))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, _TRADE, TRADE_COLUMNS)


SUPPLY = f"nodes AS ({_sql(_NODES, NODE_COLUMNS)}), edges AS ({_sql(_EDGES, EDGE_COLUMNS)})"
RAW_SUPPLY = f"nodes AS ({_sql(_NODES + _MORE_NODES, NODE_COLUMNS)}), edges AS ({_sql(_EDGES + _MORE_EDGES, EDGE_COLUMNS)})"
TRADE = f"edges AS ({_sql(_TRADE, TRADE_COLUMNS)})"

#: After SUPPLY or RAW_SUPPLY: canonical rows, then edges whose ends are ids or null.
CANON = """
cn AS (SELECT * FROM nodes WHERE coalesce(id, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord, label NULLS FIRST) = 1),
ce AS (SELECT * FROM edges WHERE coalesce(src, '') <> '' AND coalesce(dst, '') <> '' AND src IN (SELECT id FROM cn)
       QUALIFY row_number() OVER (PARTITION BY src, dst, relation, coalesce(file, '') ORDER BY ord, confidence NULLS FIRST, score NULLS FIRST, projected_from NULLS FIRST) = 1),
lab AS (SELECT label, arg_min(id, ord) AS label_id FROM cn WHERE coalesce(label, '') <> '' GROUP BY label),
built AS (SELECT * FROM (SELECT ce.* EXCLUDE (dst), coalesce(i.id, lab.label_id) AS dst, ce.dst AS dst_raw FROM ce LEFT JOIN cn i ON ce.dst = i.id LEFT JOIN lab ON ce.dst = lab.label) WHERE dst IS NOT NULL AND src <> dst)
"""

RESOLVED = """
flab AS (SELECT label, arg_min(id, ord) AS label_id FROM nodes WHERE coalesce(label, '') <> '' GROUP BY label),
ids AS (SELECT DISTINCT id FROM nodes),
re AS (SELECT e.* EXCLUDE (src, dst), coalesce(a.id, la.label_id) AS src, coalesce(b.id, lb.label_id) AS dst FROM edges e
       LEFT JOIN ids a ON e.src = a.id LEFT JOIN flab la ON e.src = la.label LEFT JOIN ids b ON e.dst = b.id LEFT JOIN flab lb ON e.dst = lb.label)
"""

SIMPLE = "sd AS (SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM (SELECT DISTINCT src, dst FROM built WHERE src <> dst)) GROUP BY id)"
