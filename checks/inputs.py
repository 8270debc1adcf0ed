"""Inputs of the registered queries: the given tables, and views on them that
add missing, mixed and broken values by rules on the rows themselves.

Each view is one SQL text per engine; they differ only in function names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2002-03-15"

_DIRTY_LINEITEM = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_discount > 0.085 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       CASE WHEN l_tax > 0.075 AND l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS l_shipdate
FROM lineitem"""

_MIXED_EVENTS = """
SELECT event_id, ts, user_id, event_type, value,
       CASE WHEN event_type = 'error' THEN CAST(value AS {text}) ELSE event_type END AS mixed,
       CASE WHEN event_type = 'click' THEN NULL ELSE value END AS sparse_value
FROM events"""

_TEXT_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'not a date'
            ELSE {iso} END AS order_date
FROM orders"""

_CONTACTS = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'user at mail'
            ELSE concat('user', c_custkey, '@mail.example') END AS email,
       CASE WHEN c_nationkey = 3 THEN 'unknown'
            ELSE concat('+', 1000000 + c_custkey) END AS phone,
       CASE WHEN c_acctbal < 0 THEN 'X1' ELSE CAST(10000 + c_nationkey AS {text}) END AS zip_code
FROM customer"""

_PERCENTS = "SELECT l_orderkey, l_linenumber, l_discount * 1100 AS disc_pct FROM lineitem"

_LABELLED = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

_PAIRS = """
SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_mktsegment = 'MACHINERY' OR c_nationkey = 3 THEN NULL ELSE c_nationkey END AS nation,
       c_acctbal AS balance
FROM customer"""

# Values far off, values of mostly one kind, repeated rows and missing dates.
_SPOILED = """
SELECT o_orderstatus,
       CASE WHEN o_orderkey % 100 < 8 THEN 1000e0 ELSE 0e0 END AS spikes,
       CASE WHEN o_orderkey % 10 < 2 THEN -50e0 WHEN o_orderkey % 10 > 7 THEN 50e0 ELSE 5e0 END AS steps,
       CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_orderdate END AS delivered
FROM orders"""

_DAILY = """
SELECT CAST({day} AS {text}) AS name, {day_ts} AS ts, count(*) AS total_rows,
       CAST(6 AS BIGINT) AS total_columns, avg(value) AS overall,
       100e0 * avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS validity
FROM events GROUP BY 1, 2"""

_SPARK = {
    "text": "STRING",
    "iso": "date_format(o_orderdate, 'yyyy-MM-dd')",
    "day": "to_date(ts)",
    "day_ts": "CAST(to_date(ts) AS TIMESTAMP)",
}
_DUCKDB = {
    "text": "VARCHAR",
    "iso": "strftime(o_orderdate, '%Y-%m-%d')",
    "day": "CAST(ts AS DATE)",
    "day_ts": "CAST(CAST(ts AS DATE) AS TIMESTAMP)",
}

_VIEWS = {
    "dirty_lineitem": _DIRTY_LINEITEM,
    "mixed_events": _MIXED_EVENTS,
    "text_orders": _TEXT_ORDERS,
    "contacts": _CONTACTS,
    "percents": _PERCENTS,
    "labelled": _LABELLED,
    "pairs": _PAIRS,
    "spoiled": _SPOILED,
    "daily": _DAILY,
    "page_links": "SELECT page_id, url FROM pages",
    "doc_texts": "SELECT text, lang, source, n_chars FROM documents",
}

# Columns of the views and tables the SQL side writes out, with their kind:
# I whole number, N other number, T text, D date.
KINDS = {
    "dirty_lineitem": (
        "l_orderkey:I l_partkey:I l_suppkey:I l_linenumber:I l_quantity:N l_extendedprice:N"
        " l_discount:N l_tax:N l_returnflag:T l_linestatus:T l_shipdate:D"
    ),
    "mixed_events": "event_id:I ts:D user_id:I event_type:T value:N mixed:T sparse_value:N",
    "text_orders": (
        "o_orderkey:I o_custkey:I o_orderstatus:T o_totalprice:N o_orderpriority:T order_date:T"
    ),
    "contacts": (
        "c_custkey:I c_name:T c_nationkey:I c_acctbal:N c_mktsegment:T email:T phone:T zip_code:T"
    ),
    "labelled": "doc_id:I lang:T source:T n_chars:I quality:I toxic:I",
    "percents": "l_orderkey:I l_linenumber:I disc_pct:N",
    "page_links": "page_id:I url:T",
    "pairs": "segment:T nation:I balance:N",
    "spoiled": "o_orderstatus:T spikes:N steps:N delivered:D",
    "doc_texts": "text:T lang:T source:T n_chars:I",
    "daily": "name:T ts:D total_rows:I total_columns:I overall:N validity:N",
    "lineitem": (
        "l_orderkey:I l_partkey:I l_suppkey:I l_linenumber:I l_quantity:N l_extendedprice:N"
        " l_discount:N l_tax:N l_returnflag:T l_linestatus:T l_shipdate:D"
    ),
    "events": "event_id:I ts:D user_id:I event_type:T value:N props:T",
    "orders": (
        "o_orderkey:I o_custkey:I o_orderstatus:T o_totalprice:N o_orderdate:D o_orderpriority:T"
    ),
    "part": "p_partkey:I p_name:T p_brand:T p_type:T p_size:I p_retailprice:N",
    "customer": "c_custkey:I c_name:T c_nationkey:I c_acctbal:N c_mktsegment:T",
}


def columns_of(name: str, kinds: str = "INTD") -> list[tuple[int, str, str]]:
    """(ordinal, column, kind) of an input, for the kinds asked for."""
    parts = [p.split(":") for p in KINDS[name].split()]
    return [(i, c, k) for i, (c, k) in enumerate(parts) if k in kinds]


def spark_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    text = _VIEWS[name].format(**_SPARK)
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if _mentions(text, t)}
    for table in tables:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(
            f"JOIN {table}", f"JOIN {{{table}}}"
        )
    return spark.sql(text, **tables)


def duckdb_input(name: str) -> str:
    """The same as an SQL text."""
    return f"SELECT * FROM {name}" if name in TABLES else _VIEWS[name].format(**_DUCKDB)


def _mentions(text: str, table: str) -> bool:
    return f"FROM {table}" in text or f"JOIN {table}" in text
