"""Forms, scans and boxes that queries derive from the tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

RECORDS = """
SELECT o_orderkey AS form_id, o_orderkey AS pos, 'L_I@' || CAST(60000 + o_orderkey AS STRING) AS record_no, 'F' || CAST(o_orderkey AS STRING) AS form_no,
  c_name AS ph_name, n_name AS ph_state, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '$' AS premium, CAST(o_orderkey % 50 AS STRING) || '$' AS discount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
SCANS = f"""
SELECT form_id, pos, record_no, form_no, ph_name, ph_state, premium, discount,
  CASE WHEN form_id % 23 = 0 THEN '' WHEN form_id % 7 = 0 THEN replace(record_no, 'L_', '') ELSE record_no END AS f_record_no,
  CASE WHEN form_id % 11 = 0 THEN replace(ph_name, 'o', '0') WHEN form_id % 13 = 0 THEN ph_name || 'x' ELSE ph_name END AS f_ph_name,
  CASE WHEN form_id % 17 = 0 THEN '' ELSE lower(ph_state) END AS f_ph_state,
  CASE WHEN form_id % 19 = 0 THEN '' ELSE premium END AS f_premium, discount AS f_discount
FROM ({RECORDS}) r
"""
SCAN_TEXT = "f_record_no || ' ' || f_ph_name || ' ' || f_ph_state || ' ' || f_premium || ' ' || f_discount"
KEYS = ["record_no", "ph_name", "ph_state", "premium", "discount"]
#: The same rows twice: in SQL of both engines, and as Spark reads the tables only once.
FIELDS = " UNION ALL ".join(f"SELECT form_id, {i} AS pos, '{i + 2}' AS serial, '{k}' AS field, {k} AS expected, f_{k} AS found FROM ({SCANS}) s{i}" for i, k in enumerate(KEYS))
FIELDS_ONCE = f"SELECT form_id, stack({len(KEYS)}, {', '.join(f"{i}, '{i + 2}', '{k}', {k}, f_{k}" for i, k in enumerate(KEYS))}) AS (pos, serial, field, expected, found) FROM ({SCANS}) s"

PARTS = """
SELECT conv_id AS folder, turn AS pos, CASE WHEN turn % 2 = 0 THEN 0.25 ELSE 0.75 END AS col,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 'L_I@' || CAST(10000 + conv_id AS STRING) || ' ' || text || ' C-123456789012'
       WHEN (conv_id + turn) % 5 IN (1, 3) THEN '@ ' || CAST(10000 + turn AS STRING) || ' ' || text || ' .' ELSE text || ' .' END AS text
FROM conversations
"""
BOXES = """
SELECT l_orderkey AS page, l_linenumber AS box, CAST(l_partkey * 37 % 1000 AS INT) AS x, CAST(l_suppkey * 53 % 1400 AS INT) AS y,
  CAST(200 + 5 * l_quantity AS INT) AS w, CAST(120 + 3 * l_quantity AS INT) AS h
FROM lineitem
"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Makes the tables known by their names; queries over them are resolved at once."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(sql)
