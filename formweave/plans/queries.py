"""One query for each operator over the given tables, and SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.catalog import ALIASES, ON_FORM, field_catalog, header_names
from formweave.catalog import FIELDS as CATALOG
from formweave.functions import canon, registered, scoring, text
from formweave.functions.similarity import with_ratio
from formweave.operators import alignment, anchors, forms, layout, matching, records, rows, search, stitch, verdict
from formweave.plans.fixtures import BOXES, FIELDS, FIELDS_ONCE, KEYS, PARTS, RECORDS, SCAN_TEXT, SCANS, derived
from formweave.sources import html
from formweave.sources.files import file_key
from formweave.sources.sinks import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL that mirror the column functions.
def strip_(x: str) -> str:
    return f"strip_accents(replace({x}, 'ß', 'ss'))"


def collapse_(x: str) -> str:
    return f"trim(regexp_replace(upper({strip_(x)}), '\\s+', ' ', 'g'))"


def key_(x: str) -> str:
    plain = f"upper(regexp_replace({strip_(x)}, '[\\s\\-,_]+', '', 'g'))"
    marked = f"regexp_replace({plain}, '^LI@', 'I@')"
    return f"translate(regexp_replace({marked}, '^[A-Z]([0-9]{{5,}})$', '\\1'), 'L|O]Q', 'II0JG')"


def digits_(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def amount_(x: str) -> str:
    return f"TRY_CAST(nullif({digits_(x)}, '') AS BIGINT)"


def total_(p: str, d: str) -> str:
    return f"coalesce(CAST({amount_(p)} - {amount_(d)} AS VARCHAR) || '$', '')"


def words_(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


STATUS = f"CASE WHEN {collapse_('expected')} = '' THEN 'match' WHEN {collapse_('found')} = '' THEN 'ocr_missed' WHEN {key_('expected')} = {key_('found')} THEN 'match' ELSE 'mismatch' END"
RESULTS = f"SELECT form_id, pos, serial, field, expected, found, {STATUS} AS status FROM ({FIELDS}) f"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = derived(spark, sf_dir, FIELDS_ONCE)
    return fields.withColumn("status", verdict.field_status(F.col("expected"), F.col("found"), F.lit(True)))


@query(f"""
SELECT form_id, checked, matched, checked - matched AS mismatched, round_even(100.0 * matched / checked, 1) AS overall_score,
  CASE WHEN checked = matched THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT form_id, count(*) AS checked, count(*) FILTER (status = 'match') AS matched FROM ({RESULTS}) r GROUP BY form_id) t""")
def form_verdict(spark, sf_dir):
    return verdict.form_summary(statuses(spark, sf_dir))


@query(f"SELECT field, status, count(*) AS n FROM ({RESULTS}) r GROUP BY field, status")
def field_status_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("field", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT form_id, NOT contains({digits_(SCAN_TEXT)}, {digits_('record_no')}) AS image_mismatch FROM ({SCANS}) s""")
def wrong_image_guard(spark, sf_dir):
    scans = derived(spark, sf_dir, f"SELECT form_id, record_no, {SCAN_TEXT} AS text FROM ({SCANS}) s")
    return scans.select("form_id", verdict.wrong_image(F.col("record_no"), F.col("text")).alias("image_mismatch"))


MONEY = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || '$' AS premium, CAST(l_linenumber AS STRING) || '$' AS discount,
  CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN '12$' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) - l_linenumber AS STRING) || '$' END AS total,
  CASE WHEN l_orderkey % 11 = 0 THEN 'x' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || '4' END AS read_premium
FROM lineitem"""
WANT = f"CASE WHEN total = '' THEN {total_('premium', 'discount')} ELSE total END"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, {total_('premium', 'discount')} AS derived_total,
  CASE WHEN {total_('read_premium', 'discount')} <> '' AND {key_(WANT)} = {key_(total_('read_premium', 'discount'))} THEN 'match' ELSE 'mismatch' END AS read_status,
  CASE WHEN {key_(WANT)} = {key_(total_('premium', 'discount'))} THEN 'match' ELSE 'mismatch' END AS own_status
FROM ({MONEY}) m""")
def total_amount_check(spark, sf_dir):
    m = derived(spark, sf_dir, MONEY)
    p, d, t, r = (F.col(c) for c in ("premium", "discount", "total", "read_premium"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", text.total_amount(p, d).alias("derived_total"), verdict.total_check(p, d, t, r, d).alias("read_status"), verdict.total_check(p, d, t, p, d).alias("own_status"))


@query(f"SELECT doc_id, md5({key_('text')}) AS compare_key, md5({collapse_('text')}) AS collapsed FROM documents")
def compare_key_docs(spark, sf_dir):
    docs = derived(spark, sf_dir, "SELECT doc_id, text FROM documents")
    md5 = lambda c: F.md5(c.cast("binary"))
    return docs.select("doc_id", md5(text.compare_key(F.col("text"))).alias("compare_key"), md5(text.collapse(F.col("text"))).alias("collapsed"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def strip_accents_docs(spark, sf_dir):
    return derived(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", F.md5(text.strip_accents(F.col("text")).cast("binary")).alias("plain"))


@query(f"SELECT doc_id, len({words_('text')}) AS n_words, list_max(list_transform({words_('text')}, lambda w: len(w))) AS longest FROM documents")
def token_stats(spark, sf_dir):
    w = text.tokens(F.col("text"))
    return derived(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_max(F.transform(w, F.length)).cast("long").alias("longest"))


@query(f"""
WITH t AS (SELECT item_id, {words_('text')} AS w FROM benchmark), s AS (SELECT item_id, w, unnest(range(len(w))) AS start FROM t),
n AS (SELECT item_id, w, start, unnest([1, 2, 3]) AS len FROM s)
SELECT item_id, CAST(start AS INT) AS start, CAST(len AS INT) AS len, array_to_string(w[start + 1 : start + len], ' ') AS words FROM n WHERE start + len <= len(w)""")
def token_windows(spark, sf_dir):
    items = derived(spark, sf_dir, "SELECT item_id, text FROM benchmark")
    found = items.select("item_id", F.explode(text.windows(text.tokens(F.col("text")), 3)).alias("x"))
    return found.select("item_id", F.col("x.start").cast("int").alias("start"), F.col("x.len").cast("int").alias("len"), "x.words")


ASKED = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'L_I@' || CAST(60000 + c_custkey AS STRING) WHEN 1 THEN ' l_i@' || CAST(60000 + c_custkey AS STRING) || ' '
  WHEN 2 THEN CAST(60000 + c_custkey AS STRING) WHEN 3 THEN 'i@6' || CAST(c_custkey AS STRING) ELSE 'none ' || c_name END AS key FROM customer"""


@query(f"""
WITH r AS (SELECT pos, record_no, lower(record_no) AS n, {digits_('record_no')} AS d FROM ({RECORDS}) x), k AS (SELECT c_custkey, key, lower(trim(key)) AS q FROM ({ASKED}) a),
kd AS (SELECT *, {digits_('q')} AS qd FROM k),
h AS (SELECT c_custkey, record_no, pos, 1 AS tier FROM kd JOIN r ON n = q UNION ALL
      SELECT c_custkey, record_no, pos, 2 FROM kd JOIN r ON d = qd AND qd <> '' UNION ALL SELECT c_custkey, record_no, pos, 2 FROM kd JOIN r ON contains(n, q)),
b AS (SELECT c_custkey, record_no, tier, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, pos) AS i FROM h)
SELECT kd.c_custkey, kd.key, b.record_no AS found, b.tier FROM kd LEFT JOIN b ON kd.c_custkey = b.c_custkey AND b.i = 1""")
def record_lookup(spark, sf_dir):
    store = derived(spark, sf_dir, RECORDS)
    return records.lookup(store, derived(spark, sf_dir, ASKED)).select("c_custkey", "key", "found", "tier")


@query(f"""SELECT record_no, ph_name, form_no, row_number() OVER (ORDER BY pos) AS place FROM ({RECORDS}) r
WHERE contains(lower(record_no || ' ' || ph_name || ' ' || form_no), 'customer#00000001') ORDER BY pos LIMIT 60""")
def record_search_top60(spark, sf_dir):
    found = records.search(derived(spark, sf_dir, RECORDS), " Customer#00000001 ")
    return found.select("record_no", "ph_name", "form_no", F.row_number().over(W.orderBy("pos")).cast("long").alias("place"))


TYPED = ["Customer#00000001", "l_i@6000", "9", "#0", "f12", "no such text", "  00 f7"]


@query(" UNION ALL ".join(f"""SELECT '{t}' AS typed, * FROM (SELECT record_no, ph_name, form_no, row_number() OVER (ORDER BY pos) AS place FROM ({RECORDS}) r
WHERE contains(lower(record_no || ' ' || ph_name || ' ' || form_no), '{t.strip().lower()}') ORDER BY pos LIMIT 60) s{i}""" for i, t in enumerate(TYPED)))
def record_search_index(spark, sf_dir):
    """Several searches over one index of the store."""
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    search.write_index(derived(spark, sf_dir, RECORDS), path)
    found = [search.search_index(spark, path, t).withColumn("place", F.row_number().over(W.orderBy("pos")).cast("long")).select(F.lit(t).alias("typed"), "record_no", "ph_name", "form_no", "place") for t in TYPED]
    return reduce(DataFrame.unionAll, found)


@query(f"SELECT record_no, form_no, ph_name FROM ({RECORDS}) r")
def record_list(spark, sf_dir):
    return derived(spark, sf_dir, RECORDS).select("record_no", "form_no", "ph_name")


STORE = "SELECT c_custkey AS pos, CASE WHEN c_custkey % 10 = 0 THEN 'Customer#dup' ELSE c_name END AS record_no, c_mktsegment AS value FROM customer"
CHANGES = "SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 9 = 0 THEN ' ' WHEN s_suppkey % 9 = 1 THEN 'Customer#dup' WHEN s_suppkey % 2 = 0 THEN replace(s_name, 'Supplier', 'Customer') || ' ' ELSE s_name END AS record_no, 'new' || CAST(s_suppkey AS STRING) AS value FROM supplier"


@query(f"""
WITH o AS (SELECT *, trim(record_no) AS k FROM ({STORE}) s), c AS (SELECT *, trim(record_no) AS k, row_number() OVER (PARTITION BY trim(record_no) ORDER BY pos DESC) AS i FROM ({CHANGES}) x),
n AS (SELECT * FROM c WHERE i = 1 AND k <> ''), f AS (SELECT o.k, min(o.pos) AS p FROM o JOIN n ON o.k = n.k GROUP BY o.k)
SELECT pos, record_no, value FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = o.k AND f.p = o.pos)
UNION ALL SELECT coalesce(f.p, (SELECT max(pos) FROM o) + 1 + n.pos), n.record_no, n.value FROM n LEFT JOIN f ON n.k = f.k""")
def record_upsert(spark, sf_dir):
    return records.upsert(derived(spark, sf_dir, STORE), derived(spark, sf_dir, CHANGES))


@query("""SELECT c_custkey, c_name AS record_no, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'short' END AS ph_city,
  CASE WHEN c_custkey % 3 = 0 THEN 'A' || CAST(c_nationkey AS VARCHAR) END AS agent_zip, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' END AS q7_glasses FROM customer""")
def schema_align(spark, sf_dir):
    c = derived(spark, sf_dir, "SELECT * FROM customer")
    pairs = F.map_concat(
        F.create_map(F.lit("record_no"), F.col("c_name"), F.lit("unknown"), F.lit("dropped")),
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("policy_holder_city"), F.col("c_mktsegment"), F.lit("ph_city"), F.lit("hidden"), F.lit(ALIASES["q7_glasses"]), F.lit("Yes"))).otherwise(F.create_map(F.lit("ph_city"), F.lit("short"))),
        F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("agent_zip_code"), F.concat(F.lit("A"), F.col("c_nationkey").cast("string")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
    )
    return records.align_schema(c.select("c_custkey", pairs.alias("raw"))).select("c_custkey", "record_no", "ph_city", "agent_zip", "q7_glasses")


HEADERS = """SELECT p_brand AS sheet, CAST(p_partkey AS INT) AS col, CASE p_size % 7 WHEN 0 THEN ' Record No ' WHEN 1 THEN 'ID' WHEN 2 THEN 'Policy Holder Name' WHEN 3 THEN 'PH_CITY'
  WHEN 4 THEN 'policy_holder_state' WHEN 5 THEN 'Agent Zip Code' ELSE p_name END AS header FROM part WHERE p_size % 7 <> 0 OR p_brand LIKE '%1%'"""


@query(f"""
WITH h AS (SELECT sheet, col, lower(trim(header)) AS name FROM ({HEADERS}) x),
m AS (SELECT * FROM (VALUES ('record no', 'record_no'), ('policy holder name', 'ph_name'), ('ph_city', 'ph_city'), ('policy_holder_state', 'ph_state'), ('agent zip code', 'agent_zip')) AS v(name, key)),
f AS (SELECT sheet, col, key FROM h JOIN m ON h.name = m.name),
i AS (SELECT sheet, min(col) AS col, 'record_no' AS key FROM h WHERE name = 'id' AND sheet NOT IN (SELECT sheet FROM f WHERE key = 'record_no') GROUP BY sheet)
SELECT sheet, key, max(col) AS col FROM (SELECT * FROM f UNION ALL SELECT sheet, col, key FROM i) u GROUP BY sheet, key""")
def header_map(spark, sf_dir):
    return records.map_headers(derived(spark, sf_dir, HEADERS), header_names(spark))


@query("""
WITH k AS (SELECT event_id AS p, unnest(json_keys(props)) AS key FROM events), n AS (SELECT event_id AS p, event_type AS key FROM events), u AS (SELECT p, 0 AS i, key FROM k UNION ALL SELECT p, 1, key FROM n),
f AS (SELECT key, min(p * 2 + i) AS seen FROM u GROUP BY key)
SELECT key, CAST(row_number() OVER (ORDER BY seen, key) AS INT) AS place FROM f""")
def csv_export_columns(spark, sf_dir):
    e = derived(spark, sf_dir, "SELECT event_id AS pos, event_type, from_json(props, 'map<string,string>') AS raw FROM events")
    raw = e.select("pos", F.map_concat("raw", F.create_map("event_type", F.lit("x"))).alias("raw"))
    return records.extra_columns(raw)


@query("""
WITH n AS (SELECT 'scraped_' || strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN event_id % 50 = 0 THEN 'x' ELSE '' END || '.json' AS name FROM events)
SELECT max(name) AS active, true AS is_scraped, count(*) AS n,
  strftime(max(try_strptime(nullif(regexp_extract(name, '^scraped_([0-9]{8}_[0-9]{6})\\.json$', 1), ''), '%Y%m%d_%H%M%S')), '%Y-%m-%d %H:%M:%S') AS last,
  (SELECT count(DISTINCT name) FROM n) AS kinds, min(name) AS oldest FROM n""")
def snapshot_status(spark, sf_dir):
    n = derived(spark, sf_dir, "SELECT 'scraped_' || date_format(ts, 'yyyyMMdd_HHmmss') || CASE WHEN event_id % 50 = 0 THEN 'x' ELSE '' END || '.json' AS name FROM events")
    of = records.store_status(n)
    return of.select("active", "is_scraped", "n", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "kinds", "oldest")


HEADED = f"SELECT form_id AS id, f_record_no || ' ' || replace(f_record_no, 'I@', ' ') || chr(10) || CASE WHEN form_id % 3 = 0 THEN f_record_no || ' ' || discount ELSE ph_name END || chr(10) || record_no AS text FROM ({SCANS}) s"


@query(f"""
WITH t AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM ({HEADED}) x), h AS (SELECT id, {digits_("array_to_string(l[1:2], '')")} AS h FROM t),
r AS (SELECT record_no, pos, {digits_('record_no')} AS d FROM ({RECORDS}) y), n AS (SELECT DISTINCT length(d) AS n FROM r),
g AS (SELECT DISTINCT id, h, substr(h, CAST(i AS BIGINT), n) AS d FROM (SELECT id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM h, n WHERE length(h) >= n) z),
c AS (SELECT id, record_no, pos, CAST((length(h) - length(replace(h, g.d, ''))) / length(g.d) AS INT) AS n FROM g JOIN r ON g.d = r.d),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS i FROM c WHERE n >= 2)
SELECT h.id, b.record_no, b.n FROM h LEFT JOIN b ON h.id = b.id AND b.i = 1""")
def record_match_by_number(spark, sf_dir):
    return matching.match_by_number(derived(spark, sf_dir, HEADED), derived(spark, sf_dir, RECORDS)).select("id", "record_no", "n")


@query("""SELECT DISTINCT key, upper(trim(value)) AS value FROM (SELECT 'p_brand' AS key, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part) u WHERE trim(value) <> ''""")
def vocab_learn(spark, sf_dir):
    return records.learn_vocabulary(derived(spark, sf_dir, "SELECT * FROM part"), ["p_brand", "p_type", "p_name"])


def lcs_(pairs: str) -> str:
    """SQL for a, b, n (length of the common subsequence) of a table of pairs: rows of the matrix by recursion."""
    return f"""
l AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: CAST(0 AS BIGINT)) AS r FROM {pairs}
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN k > 1 AND substr(b, k - 1, 1) = substr(a, i + 1, 1) THEN r[k - 1] + 1 ELSE r[k] END))) FROM l WHERE i < length(a)),
lcs AS (SELECT a, b, r[length(b) + 1] AS n FROM l WHERE i = length(a))"""


@query(f"""
WITH RECURSIVE p AS (SELECT DISTINCT upper(p_name) AS a, upper(p_type) AS b FROM part), {lcs_('p')}
SELECT p_partkey, 100.0 * 2 * n / (length(a) + length(b)) AS ratio FROM part JOIN lcs ON upper(p_name) = a AND upper(p_type) = b""")
def indel_ratio(spark, sf_dir):
    p = derived(spark, sf_dir, "SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b FROM part")
    return p.select("p_partkey", text.indel_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(f"""
WITH RECURSIVE p AS (SELECT DISTINCT upper(p_name) AS a, upper(p_type) AS b FROM part), {lcs_('p')}
SELECT p_partkey, 100.0 * 2 * n / (length(a) + length(b)) AS ratio FROM part JOIN lcs ON upper(p_name) = a AND upper(p_type) = b""")
def indel_ratio_kernel(spark, sf_dir):
    p = derived(spark, sf_dir, "SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b FROM part")
    return with_ratio(p, "a", "b").select("p_partkey", "ratio")


WORDS = "SELECT DISTINCT key, word FROM (SELECT 'nation' AS key, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN replace(n_name, 'A', '4') ELSE n_name || 'xx' END AS word FROM nation UNION ALL SELECT 'kind', replace(p_type, 'O', '0') FROM part UNION ALL SELECT 'none', p_brand FROM part) w"
KNOWN = "SELECT DISTINCT key, value FROM (SELECT 'nation' AS key, upper(n_name) AS value FROM nation UNION ALL SELECT 'kind', upper(p_type) FROM part) v"


@query(f"""
WITH RECURSIVE w AS ({WORDS}), v AS ({KNOWN}), p AS (SELECT DISTINCT upper(word) AS a, value AS b FROM w JOIN v ON w.key = v.key AND abs(length(word) - length(value)) <= 3 AND upper(word) <> value), {lcs_('p')},
s AS (SELECT w.key, word, max(CASE WHEN upper(word) = value THEN 100.0 WHEN lcs.n IS NOT NULL THEN 100.0 * 2 * n / (length(a) + length(b)) ELSE 0.0 END) AS score
  FROM w LEFT JOIN v ON w.key = v.key LEFT JOIN lcs ON a = upper(word) AND b = value GROUP BY w.key, word)
SELECT key, word, score FROM s""")
def vocab_best_match(spark, sf_dir):
    return matching.nearest_values(derived(spark, sf_dir, WORDS), derived(spark, sf_dir, KNOWN)).select("key", "word", "score")


SHAPES = """SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN CAST(p_size AS STRING) || '/1/2024' WHEN 1 THEN CAST(10000 + p_partkey AS STRING) || '-12' WHEN 2 THEN '(555) 123-' || CAST(1000 + p_partkey % 9000 AS STRING)
  WHEN 3 THEN 'a' || CAST(p_size AS STRING) || '@mail.example' WHEN 4 THEN 'N.A.' WHEN 5 THEN CAST(p_size * 10 AS STRING) || '$' WHEN 6 THEN 'AB +' WHEN 7 THEN 'P- ' || CAST(1000000 + p_partkey AS STRING)
  WHEN 8 THEN 'AB' || CAST(10000000000000 + p_partkey AS STRING) WHEN 9 THEN 'L_I@' || CAST(60000 + p_partkey AS STRING) WHEN 10 THEN 'L-Max@LifeIns_21-1' WHEN 11 THEN CAST(p_size * 5 AS STRING)
  WHEN 12 THEN 'PLAN B 3 Year' WHEN 13 THEN 'Yes.' WHEN 14 THEN CAST(p_size AS STRING) || ' ' || p_name || ' St. Apt 5' ELSE p_name || ' ' || p_type END AS value FROM part"""
KINDS = ["name", "city", "address", *scoring.RULES]


@query("WITH t AS (SELECT p_partkey, " + words_("value") + f" AS w FROM ({SHAPES}) s) " + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, CAST({scoring.score_sql(k, 'w')} AS DOUBLE) AS score FROM t" for k in KINDS))
def field_shape_scores(spark, sf_dir):
    w = derived(spark, sf_dir, SHAPES).withColumn("w", text.tokens(F.col("value")))
    every = F.array(*(F.struct(F.lit(k).alias("kind"), scoring.score(k, F.col("w")).cast("double").alias("score")) for k in KINDS))
    return w.select("p_partkey", F.explode(every).alias("x")).select("p_partkey", "x.kind", "x.score")


RAW = """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 9 = 1 THEN '12?4$' WHEN p_size % 2 = 0 THEN CAST(p_size * 11 AS STRING) || '4' ELSE ' ' || CAST(p_size AS STRING) || '$ ' END AS money,
  CAST(p_size AS STRING) || ' yaer' AS period, 'l_I@' || CAST(60000 + p_partkey AS STRING) || ' L-Max' AS invoice, '<' || substr(upper(p_name), 1, 2 + p_size % 2) AS state, 'p ' || CAST(p_partkey * 997 AS STRING) AS policy FROM part"""


@query(f"""
SELECT p_partkey, CASE WHEN money = '' OR contains(money, '?') THEN trim(money) WHEN regexp_matches(regexp_replace(trim(money), '[$4]$', ''), '^[0-9]+$') THEN regexp_replace(trim(money), '[$4]$', '') || '$' ELSE trim(money) END AS money,
  regexp_extract(period, '[0-9]+') || ' Year' AS period, regexp_replace(invoice, '^(?i:[L_I]*)@[0-9]{{4,6}}\\s*', '') AS invoice,
  CASE WHEN length(state) = 3 THEN substr(state, 2) ELSE state END AS state, CASE WHEN length({digits_('policy')}) >= 6 THEN 'P-' || {digits_('policy')} ELSE policy END AS policy FROM ({RAW}) r""")
def canonicalize_values(spark, sf_dir):
    v = derived(spark, sf_dir, RAW)
    of = {"money": "premium", "period": "period_of_insurance", "invoice": "invoice_no", "state": "ph_state", "policy": "policy_no"}
    return v.select("p_partkey", *(canon.canonical(k, F.col(c)).alias(c) for c, k in of.items()))


CHOSEN = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Credlt Card' WHEN 1 THEN 'mastercrd' WHEN 2 THEN 'PLAN-' || substr(upper(p_name), 1, 1) ELSE p_name END AS value FROM part"
CHOICE_KEYS = ("payment_option", "card_type", "plan_name")
OPTIONS = ", ".join(f"('{k}', {i}, '{o}')" for k in CHOICE_KEYS for i, o in enumerate(canon.CHOICES[k]))


@query(f"""
WITH RECURSIVE v AS ({CHOSEN}), o AS (SELECT * FROM (VALUES {OPTIONS}) AS t(key, i, option)), p AS (SELECT DISTINCT upper(value) AS a, upper(option) AS b FROM (SELECT DISTINCT value FROM v) d, o), {lcs_('p')},
r AS (SELECT value, key, option, 100.0 * 2 * n / (length(a) + length(b)) AS r, row_number() OVER (PARTITION BY value, key ORDER BY 100.0 * 2 * n / (length(a) + length(b)) DESC, i) AS k FROM (SELECT DISTINCT value FROM v) d, o JOIN lcs ON a = upper(value) AND b = upper(option)),
c AS (SELECT value, key, CASE WHEN r >= 78 THEN option ELSE value END AS c FROM r WHERE k = 1)
SELECT p_partkey, {', '.join(f"max(CASE WHEN key = '{k}' THEN c END) AS {k}" for k in CHOICE_KEYS)} FROM v JOIN c USING (value) GROUP BY p_partkey""")
def canonicalize_choices(spark, sf_dir):
    """Noisy values of small enumerations."""
    v = derived(spark, sf_dir, CHOSEN)
    return v.select("p_partkey", *(canon.canonical(k, F.col("value")).alias(k) for k in CHOICE_KEYS))


VALUES = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '555-12' WHEN c_custkey % 3 = 1 THEN '' ELSE '(555) 123-4567' END AS ph_phone, CASE WHEN c_custkey % 4 = 0 THEN '123' ELSE '12345' END AS ph_zip,
  CASE WHEN c_custkey % 5 = 0 THEN '12x4' ELSE '' END AS nominee_zip, CASE c_custkey % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'AB+' ELSE 'o' END AS blood_group FROM customer"""


@query(f"""SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN ph_zip <> '' AND length({digits_('ph_zip')}) < 5 THEN 'ZIP INVALID' END, CASE WHEN ph_phone <> '' AND length({digits_('ph_phone')}) < 10 THEN 'PHONE NO. INVALID' END,
  CASE WHEN nominee_zip <> '' AND length({digits_('nominee_zip')}) < 5 THEN 'ZIP INVALID' END, CASE WHEN upper(blood_group) IN ('A', 'B', 'AB', 'O') THEN 'BLOOD GROUP SIGN MISSING' END], lambda x: x IS NOT NULL), ', ') AS remark FROM ({VALUES}) v""")
def quality_remarks(spark, sf_dir):
    v = derived(spark, sf_dir, VALUES)
    return v.select("c_custkey", text.remarks({k: F.col(k) for k in ("ph_zip", "ph_phone", "nominee_zip", "blood_group")}).alias("remark"))


@query(f"""
WITH s AS (SELECT form_id, {SCAN_TEXT} AS text, f_record_no, f_ph_name, f_premium, f_discount FROM ({SCANS}) x), v AS (SELECT *, nullif(regexp_extract(text, '@\\s*([0-9]{{4,6}})', 1), '') AS rid FROM s)
SELECT form_id, coalesce(rid, '') AS "ID", CASE WHEN rid IS NOT NULL THEN 'L_I@' || rid ELSE f_record_no END AS record_no, f_ph_name || 's x' AS ph_name, CAST(form_id AS VARCHAR) AS ph_zip, f_premium AS premium, f_discount AS discount,
  {total_('f_premium', 'f_discount')} AS total_amount, CASE WHEN length(CAST(form_id AS VARCHAR)) < 5 THEN 'ZIP INVALID' ELSE '' END AS remark, '' AS submit_date, '' AS ph_city FROM v""")
def wide_rows(spark, sf_dir):
    s = derived(spark, sf_dir, f"SELECT form_id, {SCAN_TEXT} AS text, f_record_no, f_ph_name, f_premium, f_discount FROM ({SCANS}) x")
    value = {"record_no": F.col("f_record_no"), "ph_name": F.concat("f_ph_name", F.lit("'s \"x\" ")), "ph_zip": F.col("form_id").cast("string"), "premium": F.col("f_premium"), "discount": F.col("f_discount")}
    long = s.select("form_id", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in value.items()))).alias("cell")).select("form_id", "text", "cell.*")
    return rows.wide_rows(long).select("form_id", "ID", "record_no", "ph_name", "ph_zip", "premium", "discount", "total_amount", "remark", "submit_date", "ph_city")


def kinds_(parts: str) -> str:
    w = words_("text")
    start = f"regexp_matches(array_to_string({w}[1:2], ' '), '@\\s*[0-9]{{4,6}}')"
    whole = f"len(list_filter({w}, lambda w: regexp_matches(w, '^[Cc][-\\s]?[0-9]{{6,}}$'))) > 0 OR regexp_matches({w}[-1], '^[A-Za-z0-9]{{13,18}}$') OR len({w}) >= 66"
    return f"SELECT *, CASE WHEN NOT {start} THEN 'continuation' WHEN {whole} THEN 'complete' ELSE 'partial' END AS kind FROM ({parts}) p WHERE len({w}) > 0"


@query(f"SELECT folder, pos, kind FROM ({kinds_(PARTS)}) k")
def part_kinds(spark, sf_dir):
    return stitch.classify(derived(spark, sf_dir, PARTS)).select("folder", "pos", "kind")


@query(f"""
WITH k AS ({kinds_(PARTS)}), s AS (SELECT *, sum(CASE kind WHEN 'partial' THEN 1 WHEN 'continuation' THEN -1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY pos) AS s FROM k),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY folder ORDER BY pos)) AS m FROM s),
o AS (SELECT *, kind = 'continuation' AND m < coalesce(lag(m) OVER (PARTITION BY folder ORDER BY pos), 0) AS orphan FROM m),
n AS (SELECT *, sum(CASE WHEN kind = 'partial' THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY pos) AS kp, sum(CASE WHEN kind = 'continuation' AND NOT orphan THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY pos) AS kc FROM o)
SELECT a.folder, coalesce(b.pos, a.pos) AS pos, md5(a.text || coalesce(' ' || b.text, '')) AS text, CASE WHEN b.pos IS NULL THEN 'open' ELSE 'joined' END AS state
FROM n a LEFT JOIN n b ON a.folder = b.folder AND a.kp = b.kc AND b.kind = 'continuation' AND NOT b.orphan WHERE a.kind = 'partial'
UNION ALL SELECT folder, pos, md5(text), CASE WHEN orphan THEN 'orphan' ELSE 'complete' END FROM n WHERE orphan OR kind = 'complete'""")
def stitch_fifo(spark, sf_dir):
    out = stitch.stitch_in_order(stitch.classify(derived(spark, sf_dir, PARTS)))
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


def queued_(parts: str) -> str:
    """SQL for folder, pos, text, kind and head (the pos of the partial that a continuation joins): a queue by recursion."""
    return f"""
k AS ({kinds_(parts)}), every AS (SELECT p.folder, p.pos, p.text, coalesce(p.col, 0.5) AS col, coalesce(k.kind, 'blank') AS kind FROM ({parts}) p LEFT JOIN k ON p.folder = k.folder AND p.pos = k.pos),
f AS (SELECT folder, list({{'pos': pos, 'col': col, 'kind': kind}} ORDER BY pos) AS l FROM every GROUP BY folder),
q AS (SELECT folder, l, 0 AS i, l[1:0] AS open, CAST(NULL AS BIGINT) AS head FROM f
  UNION ALL SELECT folder, l, i + 1, CASE WHEN l[i + 1].kind = 'partial' THEN list_append(open, l[i + 1]) WHEN l[i + 1].kind = 'continuation' AND len(open) > 0 THEN list_concat(open[1 : near - 1], open[near + 1 :]) ELSE open END,
    CASE WHEN l[i + 1].kind = 'continuation' AND len(open) > 0 THEN open[near].pos END
  FROM (SELECT *, list_min(list_transform(range(1, len(open) + 1), lambda n: {{'d': abs(open[n].col - l[i + 1].col), 'n': n}})).n AS near FROM q) x WHERE i < len(l)),
joined AS (SELECT e.folder, e.pos, e.text, e.kind, q.head FROM q JOIN every e ON e.folder = q.folder AND e.pos = q.l[q.i].pos WHERE q.i > 0)"""


BY_COLUMN = f"""
WITH RECURSIVE {queued_(PARTS)}
SELECT a.folder, a.pos, md5(coalesce(h.text || ' ', '') || a.text) AS text, CASE WHEN a.kind = 'complete' THEN 'complete' WHEN a.head IS NULL THEN 'orphan' ELSE 'joined' END AS state
FROM joined a LEFT JOIN joined h ON a.folder = h.folder AND a.head = h.pos WHERE a.kind IN ('complete', 'continuation')
UNION ALL SELECT folder, pos, md5(text), 'open' FROM joined p WHERE kind = 'partial' AND NOT EXISTS (SELECT 1 FROM joined c WHERE c.folder = p.folder AND c.head = p.pos)"""


@query(BY_COLUMN)
def stitch_by_column(spark, sf_dir):
    """Greedy pairs by column, in order of arrival."""
    return stitch.stitch_by_column(stitch.classify(derived(spark, sf_dir, PARTS))).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"WITH RECURSIVE {queued_(PARTS)} SELECT folder, pos, coalesce(head, pos) AS group_pos FROM joined")
def group_forms(spark, sf_dir):
    return stitch.group_members(derived(spark, sf_dir, PARTS))


@query()
def align_forms(spark, sf_dir):
    """All scans aligned with their records: one row for each located field."""
    s = derived(spark, sf_dir, f"SELECT *, {SCAN_TEXT} AS text FROM ({SCANS}) s")
    found = alignment.align_forms(s.select("form_id", *KEYS, "text"), F.array(*KEYS), F.col("text"), KEYS)
    return found.select("form_id", F.explode("spans").alias("span")).select("form_id", "span.*")


FORM = """SELECT s_suppkey AS form_id, 'L_I@' || CAST(60000 + s_suppkey AS STRING) || ' L-Max@LifeIns_21-' || CAST(1000 + s_suppkey AS STRING) || ' 1/2/2020 AB12X 12AB34CD Ann Lee 12 Oak St. Salem OR 97301 (503) 555-0100 a.lee@mail.test 3/4/1970 N.A. '
  || 'Bob Lee 7 Elm Rd. Salem OR 97302 N.A. 90 170 150 O+ P-892915425498 AB34CD56EF78GH Acme Company 5 Main St. Reno NV 89501 ZX12CV34BN56MM QW12ER34TY56UU PLAN B PB1234 500$ 3 Year No No No No No No No No No Yes Credit Card '
  || CAST(100 + s_suppkey % 800 AS STRING) || '$ 10$ Visa C-8698231518 N.A. Ann Lee TR12AN34SA56CT' AS text FROM supplier"""


@query("""SELECT s_suppkey AS form_id, false AS overflow, 'L_I@' || CAST(60000 + s_suppkey AS VARCHAR) AS record_no, 'L-Max@LifeIns_21-' || CAST(1000 + s_suppkey AS VARCHAR) AS invoice_no, 'O+' AS blood_group, 'P-892915425498' AS policy_no,
  CAST(100 + s_suppkey % 800 AS VARCHAR) || '$' AS premium, '10$' AS discount, 'C-8698231518' AS card_no, 'TR12AN34SA56CT' AS transaction_id, '3 Year' AS period_of_insurance, 'Yes' AS q7_glasses FROM supplier""")
def segment_forms(spark, sf_dir):
    out = alignment.segment_forms(derived(spark, sf_dir, FORM), "text", {"card_type": {"VISA"}, "agent_name": {"ACME COMPANY"}})
    keys = ["record_no", "invoice_no", "blood_group", "policy_no", "premium", "discount", "card_no", "transaction_id", "period_of_insurance", "q7_glasses"]
    return out.select("form_id", "overflow", *(canon.canonical(k, F.col("values")[k]).alias(k) for k in keys))


VALIDATED = f"""
SELECT form_id % 64 AS folder, form_id * 2 AS pos, 0.25D AS col, 'img' || CAST(form_id * 2 AS STRING) AS image,
  record_no || chr(10) || record_no || chr(10) || ph_name || ' ' || ph_state || CASE WHEN form_id % 2 = 0 THEN '' ELSE ' ' || CASE WHEN form_id % 5 = 0 THEN '9' ELSE '' END || premium || ' ' || discount || ' TR12AN34SA56CT' END AS text FROM ({RECORDS}) r
UNION ALL SELECT form_id % 64, form_id * 2 + 1, 0.25D, 'img' || CAST(form_id * 2 + 1 AS STRING), CASE WHEN form_id % 5 = 0 THEN '9' ELSE '' END || premium || ' ' || discount || ' TR12AN34SA56CT' FROM ({RECORDS}) r WHERE form_id % 2 = 0
UNION ALL SELECT 7, -1 - s_suppkey, 0.5D, 'none', 'L_I@' || CAST(10000 + s_suppkey AS STRING) || ' no such record TR12AN34SA56CT' FROM supplier"""
PRINTED = len(ON_FORM) + 1


@query(f"""
SELECT CAST(form_id % 64 AS VARCHAR) || ':' || CAST(form_id * 2 AS VARCHAR) AS form_id, 'img' || CASE WHEN form_id % 2 = 0 THEN form_id * 2 + 1 ELSE form_id * 2 END AS image, CAST(CASE WHEN form_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS parts, record_no, true AS matched, false AS image_mismatch,
  CAST({PRINTED} AS BIGINT) AS checked, CAST(CASE WHEN form_id % 5 = 0 THEN {PRINTED} - 2 ELSE {PRINTED} END AS BIGINT) AS matched_fields, CAST(CASE WHEN form_id % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS mismatched,
  CASE WHEN form_id % 5 = 0 THEN round_even(100.0 * ({PRINTED} - 2) / {PRINTED}, 1) ELSE 100.0 END AS overall_score, CASE WHEN form_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({RECORDS}) r
UNION ALL SELECT '7:' || (-1 - s_suppkey), 'none', 1, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier""")
def validate_forms(spark, sf_dir):
    """Parts of forms joined, matched with their records, aligned in all located fields and judged, end to end."""
    found, _ = forms.validate(derived(spark, sf_dir, VALIDATED), derived(spark, sf_dir, RECORDS))
    return found.drop("folder", "sources")


@query(f"""
WITH v AS (SELECT *, CASE WHEN form_id % 5 = 0 THEN '9' ELSE '' END || premium AS got FROM ({RECORDS}) r), f AS (SELECT CAST(form_id % 64 AS VARCHAR) || ':' || CAST(form_id * 2 AS VARCHAR) AS form_id, unnest([
  {{'field': 'record_no', 'expected': record_no, 'found': record_no, 'status': 'match'}}, {{'field': 'ph_name', 'expected': ph_name, 'found': ph_name, 'status': 'match'}}, {{'field': 'ph_state', 'expected': ph_state, 'found': ph_state, 'status': 'match'}},
  {{'field': 'premium', 'expected': premium, 'found': got, 'status': CASE WHEN got = premium THEN 'match' ELSE 'mismatch' END}}, {{'field': 'discount', 'expected': discount, 'found': discount, 'status': 'match'}},
  {{'field': 'total_amount', 'expected': {total_('premium', 'discount')}, 'found': {total_('got', 'discount')}, 'status': CASE WHEN got = premium THEN 'match' ELSE 'mismatch' END}}]) AS x FROM v)
SELECT form_id, x.field, x.expected, x.found, x.status FROM f""")
def validate_fields(spark, sf_dir):
    _, results = forms.validate(derived(spark, sf_dir, VALIDATED), derived(spark, sf_dir, RECORDS))
    return results.where("field in ('record_no', 'ph_name', 'ph_state', 'premium', 'discount', 'total_amount')").select("form_id", "field", "expected", "found", "status")


# Names of three words, of which one may be read wrongly; word boxes by their number within a part.
BOXED = f"""
SELECT form_id, pos, record_no, 'Ann ' || ph_name || ' Lee' AS ph_name, ph_state, premium, discount, CASE WHEN form_id % 3 = 0 THEN 'Ann ' || ph_name || 'x Lee' ELSE 'Ann ' || ph_name || ' Lee' END AS read_name,
  CASE WHEN form_id % 5 = 0 THEN '9' ELSE '' END || premium AS read_premium FROM ({RECORDS}) r"""
BOXED_PARTS = f"""
SELECT folder, pos, col, image, box, text, transform(sequence(0, size(filter(split(text, '\\\\s+'), w -> w <> '')) - 1), i -> named_struct('x0', 10.0D * i, 'y0', 3.0D * i + box, 'x1', 10.0D * i + 8, 'y1', 3.0D * i + 5 + box)) AS boxes FROM (
  SELECT form_id % 64 AS folder, form_id * 2 AS pos, 0.25D AS col, 'img' || CAST(form_id * 2 AS STRING) AS image, form_id % 4 AS box,
    record_no || chr(10) || record_no || chr(10) || read_name || ' ' || ph_state || CASE WHEN form_id % 2 = 0 THEN '' ELSE ' ' || read_premium || ' ' || discount || ' TR12AN34SA56CT' END AS text FROM ({BOXED}) b
  UNION ALL SELECT form_id % 64, form_id * 2 + 1, 0.25D, 'img' || CAST(form_id * 2 + 1 AS STRING), form_id % 4, read_premium || ' ' || discount || ' TR12AN34SA56CT' FROM ({BOXED}) b WHERE form_id % 2 = 0) p"""


@query(f"""
WITH b AS (SELECT *, CAST(form_id % 64 AS VARCHAR) || ':' || CAST(form_id * 2 AS VARCHAR) AS form, len({words_('ph_state')}) AS n, CAST(form_id % 4 AS DOUBLE) AS y FROM ({BOXED}) b),
p AS (SELECT form, form_id, y, n, 0 AS part, 'img' || form_id * 2 AS image, read_name <> ph_name AS name, form_id % 2 = 1 AND read_premium <> premium AS premium, 5 + n AS place FROM b
  UNION ALL SELECT form, form_id, y, n, 1, 'img' || (form_id * 2 + 1), false, read_premium <> premium, 0 FROM b WHERE form_id % 2 = 0),
f AS (SELECT form, part, image, form_id % 4 AS box, y, unnest(list_filter([CASE WHEN name THEN {{'field': 'ph_name', 'a': 2, 'b': 4}} END, CASE WHEN premium THEN {{'field': 'premium', 'a': place, 'b': place}} END, CASE WHEN NOT name AND NOT premium THEN {{'field': NULL, 'a': NULL, 'b': NULL}} END], lambda x: x IS NOT NULL)) AS x FROM p)
SELECT form AS form_id, CAST(part AS INT) AS part, image, CAST(box AS BIGINT) AS box, x.field AS field, CAST(10 * x.a AS DOUBLE) AS x0, 3 * x.a + y AS y0, CAST(10 * x.b + 8 AS DOUBLE) AS x1, 3 * x.b + 5 + y AS y1 FROM f""")
def validate_boxes(spark, sf_dir):
    """Parts of validated forms with the boxes around what was read wrongly on them."""
    found, _ = forms.validate(derived(spark, sf_dir, BOXED_PARTS), derived(spark, sf_dir, BOXED))
    out = found.select("form_id", F.posexplode("sources").alias("part", "s")).select("form_id", "part", "s.image", "s.box", F.explode_outer("s.fields").alias("f"))
    return out.select("form_id", "part", "image", "box", "f.field", *(F.col("f.box")[c].alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""SELECT '0:' || s_suppkey AS form_id, 'complete' AS state, CAST(60000 + s_suppkey AS VARCHAR) AS "ID", 'L_I@' || CAST(60000 + s_suppkey AS VARCHAR) AS record_no, 'O+' AS blood_group, 'P-892915425498' AS policy_no, CAST(100 + s_suppkey % 800 AS VARCHAR) || '$' AS premium, '10$' AS discount,
  CAST(90 + s_suppkey % 800 AS VARCHAR) || '$' AS total_amount, 'C-8698231518' AS card_no, '' AS submit_date FROM supplier""")
def extract_rows(spark, sf_dir):
    """Texts of forms stitched, segmented, made canonical and laid out as output rows."""
    parts = derived(spark, sf_dir, f"SELECT 0 AS folder, form_id AS pos, 0.5D AS col, text FROM ({FORM}) f")
    out = forms.extract(parts, {"card_type": {"VISA"}, "agent_name": {"ACME COMPANY"}})
    return out.select("form_id", "state", "ID", "record_no", "blood_group", "policy_no", "premium", "discount", "total_amount", "card_no", "submit_date")


#: The same forms as cells, some of several words, cut in two before the nominee.
BOUND = ["Ann Lee", "12 Oak St.", "(503) 555-0100", "Bob Lee", "7 Elm Rd.", "Acme Company", "5 Main St.", "PLAN B", "3 Year", "Credit Card"]
_bound = "text"
for _b in BOUND:
    _bound = f"replace({_bound}, '{_b}', '{_b.replace(' ', '~')}')"
CELL_HALVES = f"""
SELECT 0 AS folder, 2 * form_id + half AS pos, transform(filter(split(CASE WHEN half = 0 THEN split_part(t, 'Bob~Lee', 1) ELSE 'Bob~Lee' || split_part(t, 'Bob~Lee', 2) END, ' '), c -> c <> ''), c -> replace(c, '~', ' ')) AS cells
FROM (SELECT form_id, {_bound} AS t, explode(array(0, 1)) AS half FROM ({FORM}) f) h"""


@query("""SELECT '0:' || (2 * s_suppkey + 1) AS form_id, 'joined' AS state, CAST(60000 + s_suppkey AS VARCHAR) AS "ID", 'L_I@' || CAST(60000 + s_suppkey AS VARCHAR) AS record_no, 'Ann Lee' AS ph_name, '12 Oak St.' AS ph_address, 'Bob Lee' AS nominee_name, 'O+' AS blood_group, 'P-892915425498' AS policy_no, 'Acme Company' AS agent_name,
  CAST(100 + s_suppkey % 800 AS VARCHAR) || '$' AS premium, '10$' AS discount, CAST(90 + s_suppkey % 800 AS VARCHAR) || '$' AS total_amount, 'C-8698231518' AS card_no FROM supplier""")
def extract_cells(spark, sf_dir):
    """Cells of forms in two halves, stitched, segmented by whole cells and laid out as output rows."""
    joined = forms.stitch_cells(derived(spark, sf_dir, CELL_HALVES))
    out = forms.extract_cell_rows(joined, {"card_type": {"VISA"}, "agent_name": {"ACME COMPANY"}})
    return out.select("form_id", "state", "ID", "record_no", "ph_name", "ph_address", "nominee_name", "blood_group", "policy_no", "agent_name", "premium", "discount", "total_amount", "card_no")


@query(f"""SELECT form_id, matched, mismatched, matched + mismatched AS checked, CASE WHEN matched + mismatched > 0 THEN round_even(100.0 * matched / (matched + mismatched), 1) ELSE 0.0 END AS overall_score, CASE WHEN mismatched = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT form_id, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'mismatch') AS mismatched FROM ({RESULTS}) r GROUP BY form_id) t""")
def edited_recompute(spark, sf_dir):
    return verdict.recomputed(statuses(spark, sf_dir))


@query("SELECT form_id, matched FROM (SELECT doc_id AS form_id, quality > 0 AS matched FROM labels) l WHERE NOT matched")
def unmapped_filter(spark, sf_dir):
    return records.by_mapping(derived(spark, sf_dir, "SELECT doc_id AS form_id, quality > 0 AS matched FROM labels"), mapped=False)


@query(f"SELECT p_partkey, strip_accents(p_name || 'é') AS plain, {key_("p_type || ' é-L'")} AS key, CAST(100.0 AS DOUBLE) AS same, 2 AS runs, 1 AS alike FROM part")
def sql_functions(spark, sf_dir):
    registered.register(spark)
    return derived(spark, sf_dir, "SELECT p_partkey, strip_accents(p_name || 'é') AS plain, compare_key(p_type || ' é-L') AS key, indel_ratio(p_name, p_name) AS same, size(char_diff(p_name, p_name || 'x')) AS runs, size(align_form(array(upper(p_name)), split(upper(p_name), ' '))) AS alike FROM part")


CELL_PARTS = f"SELECT folder, pos, split(text, ' ') AS cells FROM ({PARTS}) p"


@query(ORACLE_SQL["stitch_fifo"].replace("md5(a.text || coalesce(' ' || b.text, '')) AS text", "len(string_split(a.text || coalesce(' ' || b.text, ''), ' ')) AS cells").replace("md5(text)", "len(string_split(text, ' '))"))
def cell_stitch(spark, sf_dir):
    out = forms.stitch_cells(derived(spark, sf_dir, CELL_PARTS))
    return out.withColumn("cells", F.size("cells").cast("long"))


# \b of the SQL engine knows ASCII words only, so there other letters are made `_` once the e-mail is found; no pattern takes that.
EMAIL_, PHONE_, ZIP_ = anchors.EMAIL, "[(]?[0-9]{3}[)]?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}", "\\b[0-9]{5}(?:-[0-9]{4})?\\b"


def past_(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, '(?s)^.*?(?:{pattern})', '')"


@query(f"""
WITH e AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F\\PL]', '_', 'g') AS text, coalesce(list_filter(regexp_extract_all(text, '{EMAIL_}'), lambda x: NOT contains(x, '@LifeIns'))[1], '') AS ph_email FROM documents),
h AS (SELECT *, CASE WHEN ph_email = '' THEN text ELSE split_part(text, ph_email, 1) END AS h FROM e), d AS (SELECT *, regexp_extract(h, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AS day FROM h),
c AS (SELECT *, {past_(past_(past_('h', anchors.RECORD), anchors.RECORD + '|' + anchors.INVOICE), anchors.DATE)} AS c FROM d),
k AS (SELECT *, regexp_extract(c, '{anchors.CUSTOMER}') AS customer_id, {past_('c', anchors.CUSTOMER)} AS f, trim({past_(past_('c', anchors.CUSTOMER), anchors.FILE_NO)}) AS k FROM c),
p AS (SELECT *, regexp_extract(k, '{PHONE_}') AS phone FROM k),
z AS (SELECT *, CASE WHEN phone = '' THEN k ELSE split_part(k, phone, 1) || ' ' || substr(k, instr(k, phone) + length(phone)) END AS hz FROM p), y AS (SELECT *, regexp_extract(hz, '{ZIP_}') AS zip FROM z)
SELECT doc_id, ph_email, customer_id, regexp_extract(f, '{anchors.FILE_NO}') AS file_no, trim(phone) AS ph_phone, zip AS ph_zip, day AS date_of_purchase,
  coalesce(list_filter(string_split_regex(CASE WHEN zip = '' THEN hz ELSE split_part(hz, zip, 1) || ' ' || substr(hz, instr(hz, zip) + length(zip)) END, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains([{', '.join(f"'{s}'" for s in anchors.STATES)}], x))[1], '') AS ph_state, regexp_extract(text, 'P-[A-Za-z0-9]{{10,}}') AS policy_no FROM y""")
def anchor_extract(spark, sf_dir):
    return anchors.anchored(derived(spark, sf_dir, "SELECT doc_id, text FROM documents")).select("doc_id", "ph_email", "customer_id", "file_no", "ph_phone", "ph_zip", "date_of_purchase", "ph_state", "policy_no")


@query("""SELECT s_suppkey AS form_id, 'L_I@' || CAST(60000 + s_suppkey AS VARCHAR) AS record_no, '1/2/2020' AS date_of_purchase, 'a.lee@mail.test' AS ph_email, '(503) 555-0100' AS ph_phone, '97301' AS ph_zip, '3/4/1970' AS ph_dob, 'OR' AS nominee_state, 'O+' AS blood_group,
  'P-892915425498' AS policy_no, 'AB34CD56EF78GH' AS reference_no, 'ZX12CV34BN56MM' AS agent_code, 'QW12ER34TY56UU' AS agent_licence_no, 'PLAN B' AS plan_name, 'PB1234' AS plan_code, '500$' AS sum_of_insured, '3 Year' AS period_of_insurance, 'No' AS q1_alcohol, 'Yes' AS q7_glasses,
  'Credit Card' AS payment_option, CAST(100 + s_suppkey % 800 AS VARCHAR) || '$' AS premium, '10$' AS discount, CAST(90 + s_suppkey % 800 AS VARCHAR) || '$' AS total_amount, 'Visa' AS card_type, 'TR12AN34SA56CT' AS transaction_id,
  'AB12X' AS customer_id, '12AB34CD' AS file_no, 'Ann Lee' AS ph_name, '12 Oak St.' AS ph_address, 'Salem' AS ph_city, 'N.A.' AS education, 'Bob Lee' AS nominee_name, '7 Elm Rd.' AS nominee_address, 'Salem' AS nominee_city, '97302' AS nominee_zip, 'N.A.' AS relation_with_nominee,
  '90' AS chest, '170' AS height, '150' AS weight, 'Acme Company' AS agent_name, '5 Main St.' AS agent_address, 'Reno' AS agent_city, 'NV' AS agent_state, '89501' AS agent_zip, 'Ann Lee' AS card_holder_name FROM supplier""")
def anchor_extract_forms(spark, sf_dir):
    out = anchors.anchored(derived(spark, sf_dir, FORM))
    return out.select("form_id", "record_no", "date_of_purchase", "ph_email", "ph_phone", "ph_zip", "ph_dob", "nominee_state", "blood_group", "policy_no", "reference_no", "agent_code", "agent_licence_no", "plan_name", "plan_code", "sum_of_insured", "period_of_insurance", "q1_alcohol", "q7_glasses", "payment_option", "premium", "discount", "total_amount", "card_type", "transaction_id", "customer_id", "file_no", "ph_name", "ph_address", "ph_city", "education", "nominee_name", "nominee_address", "nominee_city", "nominee_zip", "relation_with_nominee", "chest", "height", "weight", "agent_name", "agent_address", "agent_city", "agent_state", "agent_zip", "card_holder_name")


#: Shapes of addresses (# is a house number, ~ the name of a street) and cities that go with them.
HOUSES = [
    ("# ~ St.", "Salem"), ("P.O. Box 77", "Reno"), ("N.A.", "Reno"), ("Salem", "Salem"), ("# ~", "Silver Springs"), ("# ~ Suite 4", "Dover"), ("# ~ St. Apt 5", "Reno"), ("# ~ St NW Second Floor", "Reno"), ("# ~", "Los Angeles"), ("New York", "New York"),
    ("# Avenue of the Americas", "New York"), ("# Broadway Ave", "Dover"), ("West ~ Road", "Salem"), ("Five ~ Lane", "Dover"), ("# ~ Rd", "South Bend"), ("# ~ Rd South", "Reno"), ("# Rural P.O. Box 9", "Reno"), ("# ~ #12", "Dover"), ("# ~", "Salt Lake City"), ("# ~ Dr 7 2nd fl Rm 3", "Mesa"),
]
ADDRESSES = f"""
SELECT c_custkey, 'Ann ' || c_mktsegment AS name, replace(replace(element_at(array({', '.join(f"'{a}'" for a, _ in HOUSES)}), CAST(c_custkey % {len(HOUSES)} + 1 AS INT)), '# ', CAST(1 + c_custkey % 900 AS STRING) || ' '), '~', element_at(array('Oak', 'Elm', 'Boston', 'Mill Hill'), CAST(c_custkey % 4 + 1 AS INT))) AS address,
  element_at(array({', '.join(f"'{c}'" for _, c in HOUSES)}), CAST(c_custkey % {len(HOUSES)} + 1 AS INT)) AS city, '(503) 555-' || CAST(1000 + c_custkey % 9000 AS STRING) AS phone FROM customer"""


@query(f"""SELECT c_custkey, name, address, city, 'OR' AS state, '97301' AS zip, phone FROM ({ADDRESSES.replace('element_at(array(', 'list_extract(list_value(')}) a""")
def address_split(spark, sf_dir):
    """Holder blocks of customers in many shapes, split by the first rule that fits."""
    blocks = derived(spark, sf_dir, f"SELECT c_custkey, name || ' ' || address || ' ' || city || ' OR 97301 ' || phone AS block FROM ({ADDRESSES}) a")
    return anchors.split_holder(blocks, "block").drop("block")


NOTES = "SELECT doc_id AS form_id, CASE WHEN quality = 1 THEN 'ph_name' ELSE 'ph_state' END AS field, 'checked' AS note FROM labels"


@query(f"""
WITH r AS (SELECT r.form_id, CASE WHEN status = 'mismatch' AND n.note IS NOT NULL THEN 'false_positive' ELSE status END AS status FROM ({RESULTS}) r LEFT JOIN ({NOTES}) n ON r.form_id = n.form_id AND r.field = n.field),
c AS (SELECT form_id, count(*) FILTER (status <> 'ocr_missed') AS checked, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'false_positive') AS false_positives, count(*) FILTER (status = 'mismatch') AS mismatched, count(*) FILTER (status = 'ocr_missed') AS missed FROM r GROUP BY form_id)
SELECT *, round(100.0 * (matched + false_positives) / checked, 1) AS review_score, CASE WHEN mismatched = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict_review, CASE WHEN mismatched + false_positives + missed = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict_api FROM c""")
def overrides_recompute(spark, sf_dir):
    results = statuses(spark, sf_dir)
    return verdict.review_summary(verdict.reviewed(results, derived(spark, sf_dir, NOTES)))


@query(f"SELECT field, status, count(*) AS n, count(*) FILTER (found = '') AS empty FROM (SELECT field, status, CASE WHEN trim(found) = '' THEN expected ELSE found END AS found FROM ({RESULTS}) r) f GROUP BY field, status")
def filled_for_export(spark, sf_dir):
    out = verdict.filled(statuses(spark, sf_dir), keep_status=True)
    return out.groupBy("field", "status").agg(F.count("*").alias("n"), F.sum((F.col("found") == "").cast("long")).alias("empty"))


@query(f"""
WITH RECURSIVE f AS (SELECT *, {key_('expected')} AS a, {key_('found')} AS b FROM ({RESULTS}) r), p AS (SELECT DISTINCT a, b FROM f WHERE status = 'mismatch'), {lcs_('p')}
SELECT form_id, field, status, CASE WHEN {collapse_('expected')} = '' OR status = 'match' THEN 100.0 WHEN status = 'ocr_missed' THEN 0.0 ELSE round_even(100.0 * 2 * n / (length(f.a) + length(f.b)), 1) END AS score,
  CASE WHEN {collapse_('expected')} = '' OR status = 'ocr_missed' THEN '' WHEN status = 'match' THEN expected ELSE found END AS found
FROM f LEFT JOIN lcs ON f.a = lcs.a AND f.b = lcs.b""")
def field_details(spark, sf_dir):
    """Field results with scores and what is shown."""
    fields = derived(spark, sf_dir, FIELDS_ONCE).withColumn("on_form", F.lit(True))
    return verdict.field_results(fields).select("form_id", "field", "status", "score", "found")


@query(f"""
WITH f AS (SELECT conv_id % 7 AS folder, conv_id AS image, turn % 2 AS matched, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS passed FROM conversations)
SELECT folder, image, count(*) AS forms, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(passed) AS BIGINT) AS passed, CAST(grouping_id(folder, image) AS INT) AS level FROM f GROUP BY ROLLUP (folder, image)""")
def batch_totals(spark, sf_dir):
    return rows.batch_totals(derived(spark, sf_dir, "SELECT conv_id % 7 AS folder, conv_id AS image, turn % 2 AS matched, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS passed FROM conversations"))


PATHS = "SELECT CASE WHEN doc_id % 40 = 0 THEN '' ELSE 'In/' || source || '/' || lang || '/' END || 'f' || CAST(doc_id AS STRING) || '.png' AS path FROM documents"


@query(f"""
WITH f AS (SELECT coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '(files)') AS folder FROM ({PATHS}) p), g AS (SELECT folder, count(*) AS files FROM f GROUP BY folder)
SELECT folder, regexp_extract(folder, '([^/]*)$', 1) AS label, files, CAST(row_number() OVER (ORDER BY encode(array_to_string(list_transform(regexp_extract_all(lower(folder), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(ltrim(p, '0'), 20, '0') ELSE p END), '')), folder) AS INT) AS place FROM g""")
def folder_groups(spark, sf_dir):
    return rows.folders(derived(spark, sf_dir, PATHS))


@query("""
WITH v AS (SELECT user_id AS page, CAST(floor(value) AS BIGINT) AS v FROM events), l AS (SELECT *, v - lag(v) OVER (PARTITION BY page ORDER BY v) AS d FROM v),
c AS (SELECT page, v, sum(CASE WHEN d >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY v RANGE UNBOUNDED PRECEDING) AS cluster FROM l)
SELECT page, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, CAST(trunc(median(v)) AS INT) AS centre FROM c GROUP BY page, cluster""")
def gap_clusters(spark, sf_dir):
    v = derived(spark, sf_dir, "SELECT user_id AS page, CAST(floor(value) AS BIGINT) AS v FROM events")
    return layout.clusters(v, F.lit(3))


@query("""
WITH v AS (SELECT DISTINCT user_id AS page, CAST(floor(value) AS BIGINT) AS centre FROM events), d AS (SELECT page, lead(centre) OVER (PARTITION BY page ORDER BY centre) - centre AS d FROM v)
SELECT page, CAST(trunc(median(d)) AS INT) AS pitch FROM d GROUP BY page""")
def row_pitch(spark, sf_dir):
    return layout.pitch(derived(spark, sf_dir, "SELECT DISTINCT user_id AS page, CAST(floor(value) AS BIGINT) AS centre FROM events"))


NUMBERED = f"SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY box, x, y, w, h) AS INT) AS box, x, y, w, h FROM ({BOXES}) b0"


@query(f"""
WITH b AS ({NUMBERED}), p AS (SELECT a.page, a.box AS a, b.box AS b, a.w * a.h + b.w * b.h AS area, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM b a JOIN b ON a.page = b.page AND a.box < b.box)
SELECT page, a, b, CAST(i AS DOUBLE) / (area - i) AS iou FROM p WHERE i > 0""")
def iou_pairs(spark, sf_dir):
    return layout.overlapping_pairs(derived(spark, sf_dir, NUMBERED))


@query(f"SELECT page, box, x, y, w, h FROM ({NUMBERED}) b WHERE w BETWEEN 0.25 * 1000 AND 0.7 * 1000 AND h BETWEEN 0.05 * 1400 AND 0.45 * 1400")
def box_candidates(spark, sf_dir):
    return layout.candidates(derived(spark, sf_dir, NUMBERED), F.lit(1000), F.lit(1400))


@query(f"SELECT page, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM ({NUMBERED}) b GROUP BY page")
def box_union(spark, sf_dir):
    return layout.page_union(derived(spark, sf_dir, NUMBERED))


def overlap_(a: str, b: str) -> str:
    side = lambda p, n: f"greatest(0, least({a}.{p} + {a}.{n}, {b}.{p} + {b}.{n}) - greatest({a}.{p}, {b}.{p}))"
    inter = f"({side('x', 'w')} * {side('y', 'h')})"
    return f"(CASE WHEN {inter} = 0 THEN 0.0 ELSE CAST({inter} AS DOUBLE) / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}) END)"


@query(f"""
WITH RECURSIVE a AS (SELECT page, list({{'box': box, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY -w * h, box) AS l FROM ({NUMBERED}) b GROUP BY page),
r AS (SELECT page, l, 0 AS i, l[1:0] AS kept FROM a UNION ALL
  SELECT page, l, i + 1, CASE WHEN len(list_filter(kept, lambda k: {overlap_('k', 'l[i + 1]')} >= 0.3)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM r WHERE i < len(l)),
f AS (SELECT page, kept, unnest(range(len(kept))) AS n FROM r WHERE i = len(l))
SELECT page, CAST(n AS INT) AS rank, kept[n + 1].box AS box FROM f""")
def nms(spark, sf_dir):
    return layout.suppress(derived(spark, sf_dir, NUMBERED)).select("page", "rank", "box")


@query(f"""
WITH RECURSIVE a AS (SELECT page, list({{'box': box, 'x': x, 'y': y}} ORDER BY y, box, x) AS l FROM ({NUMBERED}) b GROUP BY page),
r AS (SELECT page, l, 0 AS i, -1 AS row, CAST(NULL AS BIGINT) AS top FROM a UNION ALL
  SELECT page, l, i + 1, CASE WHEN top IS NULL OR l[i + 1].y - top > 120 THEN row + 1 ELSE row END, CASE WHEN top IS NULL OR l[i + 1].y - top > 120 THEN l[i + 1].y ELSE top END FROM r WHERE i < len(l))
SELECT page, l[i].box AS box, CAST(row AS INT) AS row, CAST(row_number() OVER (PARTITION BY page ORDER BY row, l[i].x, l[i].box) - 1 AS INT) AS place FROM r WHERE i > 0""")
def reading_order(spark, sf_dir):
    return layout.reading_order(derived(spark, sf_dir, NUMBERED), 120).select("page", "box", "row", "place")


@query(f"""
WITH RECURSIVE w AS (SELECT page, 'w' || CAST(box AS VARCHAR) AS text, y + h / 2.0 AS cy, x + w / 2.0 AS cx, CAST(h AS DOUBLE) AS h FROM ({NUMBERED}) b),
a AS (SELECT page, list({{'cy': CAST(cy AS DOUBLE), 'cx': CAST(cx AS DOUBLE), 'text': text}} ORDER BY cy, cx, text) AS l, 0.6 * median(h) AS gap FROM w GROUP BY page),
r AS (SELECT page, l, gap, 0 AS i, -1 AS line, CAST(0 AS DOUBLE) AS s, 0 AS n FROM a UNION ALL
  SELECT page, l, gap, i + 1, CASE WHEN n > 0 AND abs(l[i + 1].cy - s / n) <= gap THEN line ELSE line + 1 END, CASE WHEN n > 0 AND abs(l[i + 1].cy - s / n) <= gap THEN s + l[i + 1].cy ELSE l[i + 1].cy END,
    CASE WHEN n > 0 AND abs(l[i + 1].cy - s / n) <= gap THEN n + 1 ELSE 1 END FROM r WHERE i < len(l))
SELECT page, CAST(line AS INT) AS line, string_agg(l[i].text, ' ' ORDER BY l[i].cx, l[i].text) AS text FROM r WHERE i > 0 GROUP BY page, line""")
def reading_lines(spark, sf_dir):
    words = derived(spark, sf_dir, f"SELECT page, 'w' || CAST(box AS STRING) AS text, y + h / 2.0D AS cy, x + w / 2.0D AS cx, CAST(h AS DOUBLE) AS h FROM ({NUMBERED}) b")
    return layout.reading_lines(words)


#: What is printed on a page: words of a line each, which do not overlap.
INK = f"SELECT page, CAST(box % 8 * 120 AS INT) AS x, CAST(floor(box / 8) * 100 + page % 13 * 60 AS INT) AS y, CAST(40 + (x + y) % 70 AS INT) AS w, CAST(20 + h % 60 AS INT) AS h FROM ({NUMBERED}) n"


def groups_(v: str, gap: str) -> str:
    """Clusters of box places: page, c, with gap as a part of the page's median."""
    return f"""SELECT page, CAST(floor(median(v)) AS BIGINT) AS c FROM (SELECT page, v, sum(new) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT b.page, {v} AS v, CASE WHEN {v} - lag({v}) OVER (PARTITION BY b.page ORDER BY {v}) >= 0.5 * {gap} THEN 1 ELSE 0 END AS new FROM b JOIN s ON b.page = s.page) x) y GROUP BY page, k"""


@query(f"""
WITH RECURSIVE b AS ({NUMBERED}), i AS ({INK}), s AS (SELECT page, CAST(floor(median(w)) AS BIGINT) AS mw, CAST(floor(median(h)) AS BIGINT) AS mh FROM b GROUP BY page), cx AS ({groups_('x', 'mw')}), ry AS ({groups_('y', 'mh')}),
d AS (SELECT page, c - lag(c) OVER (PARTITION BY page ORDER BY c) AS d FROM ry), q AS (SELECT page, CAST(floor(median(d)) AS BIGINT) AS pitch FROM d GROUP BY page),
o AS (SELECT s.page, mw, mh, CASE WHEN coalesce(pitch, 0) < 0.5 * mh THEN mh ELSE pitch END AS step, greatest(40, CAST(floor(0.3 * mh) AS BIGINT)) AS least_, top, low FROM s JOIN q ON s.page = q.page JOIN (SELECT page, min(c) AS top, max(c) AS low FROM ry GROUP BY page) t ON s.page = t.page),
y AS (SELECT page, c AS y FROM ry UNION SELECT page, y FROM (SELECT page, mh, least_, unnest(list_concat(list_transform(range(1, 60), lambda n: top - n * step), list_transform(range(1, 60), lambda n: low + n * step))) AS y FROM o) z WHERE least(1400, y + mh) - greatest(0, y) >= least_),
c AS (SELECT o.page, y.y AS ry, cx.c AS x, greatest(0, y.y) AS y, mw AS w, least(1400, y.y + mh) - greatest(0, y.y) AS h FROM o JOIN y ON o.page = y.page JOIN cx ON o.page = cx.page),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = c.page AND {overlap_('c', 'b')} > 0.2)
  AND (SELECT coalesce(sum(greatest(0, least(c.x + c.w, i.x + i.w, 1000) - greatest(c.x, i.x)) * greatest(0, least(c.y + c.h, i.y + i.h) - greatest(c.y, i.y))), 0) FROM i WHERE i.page = c.page) > 0.02 * (least(1000, c.x + c.w) - c.x) * c.h),
a AS (SELECT page, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY ry, x) AS l FROM f GROUP BY page),
r AS (SELECT page, l, 0 AS i, l[1:0] AS kept FROM a UNION ALL SELECT page, l, i + 1, CASE WHEN len(list_filter(kept, lambda k: {overlap_('k', 'l[i + 1]')} > 0.2)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM r WHERE i < len(l)),
g AS (SELECT page, unnest(kept) AS k FROM r WHERE i = len(l))
SELECT page, CAST(k.x AS INT) AS x, CAST(k.y AS INT) AS y, CAST(k.w AS INT) AS w, CAST(k.h AS INT) AS h FROM g""")
def grid_cells(spark, sf_dir):
    """Cells that sheets should also have, where something is printed."""
    boxes = derived(spark, sf_dir, NUMBERED)
    return layout.grid_cells(boxes, boxes.select("page").distinct().withColumns({"width": F.lit(1000), "height": F.lit(1400)}), derived(spark, sf_dir, INK))


@query(f"""
WITH b AS ({NUMBERED}), i AS ({INK})
SELECT b.page, b.box, round(CAST(coalesce(sum(greatest(0, least(b.x + b.w, i.x + i.w, 1000) - greatest(b.x, i.x)) * greatest(0, least(b.y + b.h, i.y + i.h, 1400) - greatest(b.y, i.y))), 0) AS DOUBLE) / greatest(1, max((least(1000, b.x + b.w) - b.x) * (least(1400, b.y + b.h) - b.y))), 9) AS ink
FROM b LEFT JOIN i ON b.page = i.page GROUP BY b.page, b.box""")
def ink_shares(spark, sf_dir):
    """How much of each box is printed on."""
    boxes = derived(spark, sf_dir, NUMBERED)
    pages = boxes.select("page").distinct().withColumns({"width": F.lit(1000), "height": F.lit(1400)})
    return layout.ink_shares(boxes, derived(spark, sf_dir, INK), pages).select("page", "box", F.round("ink", 9).alias("ink"))


LINES = f"SELECT page, box AS line, x AS x0, y + h + CAST(box % 3 AS INT) * 10 AS y0, x + w AS x1 FROM ({NUMBERED}) b WHERE box % 2 = 0"


@query(f"""
WITH w AS (SELECT page, box AS word, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM ({NUMBERED}) b), l AS ({LINES}),
g AS (SELECT w.page, w.word, l.line, row_number() OVER (PARTITION BY w.page, w.word ORDER BY abs(l.y0 - w.y1), l.line) AS i FROM w JOIN l ON w.page = l.page
  WHERE least(w.x1, l.x1) - greatest(w.x0, l.x0) > 0 AND l.y0 - w.y1 BETWEEN -0.3 * greatest(1, w.y1 - w.y0) AND 1.2 * greatest(1, w.y1 - w.y0))
SELECT w.page, w.word, g.line FROM w LEFT JOIN g ON w.page = g.page AND w.word = g.word AND g.i = 1""")
def word_underlines(spark, sf_dir):
    words = derived(spark, sf_dir, f"SELECT page, box AS word, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM ({NUMBERED}) b")
    return matching.nearest_underline(words, derived(spark, sf_dir, LINES)).select("page", "word", "line")


@query("""
WITH w AS (SELECT conv_id AS page, turn AS word, role AS text, CASE WHEN turn % 4 < 2 THEN turn // 2 WHEN turn % 4 = 2 THEN 9 END AS line FROM conversations), l AS (SELECT *, lag(line) OVER (PARTITION BY page ORDER BY word) AS p FROM w),
c AS (SELECT *, sum(CASE WHEN line IS NULL OR p IS NULL OR p <> line THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY word) AS cell FROM l)
SELECT page, CAST(cell AS BIGINT) AS cell, string_agg(text, ' ' ORDER BY word) AS text FROM c GROUP BY page, cell""")
def underline_cells(spark, sf_dir):
    return matching.cells(derived(spark, sf_dir, "SELECT conv_id AS page, turn AS word, role AS text, CASE WHEN turn % 4 < 2 THEN turn div 2 WHEN turn % 4 = 2 THEN 9 END AS line FROM conversations"))


@query(f"""
WITH p AS (SELECT conv_id AS form, turn AS part, len({words_('text')}) AS words FROM conversations), t AS (SELECT form, unnest(range(CAST(sum(words) AS BIGINT))) AS token FROM p GROUP BY form),
o AS (SELECT form, part, words, coalesce(sum(words) OVER (PARTITION BY form ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT t.form, CAST(t.token AS INT) AS token, o.part FROM t LEFT JOIN o ON t.form = o.form AND t.token >= b AND t.token < b + words""")
def span_offsets(spark, sf_dir):
    c = derived(spark, sf_dir, "SELECT conv_id AS form, turn AS part, text FROM conversations")
    parts = c.select("form", "part", F.size(text.tokens(F.col("text"))).alias("words"))
    words = parts.groupBy("form").agg(F.sum("words").cast("int").alias("n")).where("n > 0")
    words = words.select("form", "n", F.explode(F.expr("sequence(0, n - 1, 4096)")).alias("b")).select("form", F.explode(F.expr("sequence(b, least(b + 4095, n - 1))")).alias("token"))
    return matching.owner_of_tokens(words, parts)


@query("""
WITH a AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1), lambda x: starts_with(x, '/')) AS l FROM pages),
u AS (SELECT page_id, unnest(range(len(l))) AS n, l FROM a)
SELECT page_id, CAST(n AS INT) AS n, 'https://records.example/' || regexp_replace(l[n + 1], '^/+', '') AS url FROM u""")
def html_links(spark, sf_dir):
    return html.links(derived(spark, sf_dir, "SELECT page_id, html FROM pages"), "/", "https://records.example")


@query("""
SELECT doc_id, md5(source || '/' || CAST(doc_id AS VARCHAR) || '/' || CAST(n_chars AS VARCHAR) || '/' || CAST(doc_id * 10 AS VARCHAR)) AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def ocr_cache_anti_join(spark, sf_dir):
    files = derived(spark, sf_dir, "SELECT doc_id, source || '/' || CAST(doc_id AS STRING) AS path, n_chars AS length, timestamp_seconds(doc_id * 10) AS modificationTime FROM documents")
    keyed = files.withColumn("key", file_key(F.col("path"), F.col("length"), F.col("modificationTime")))
    done = keyed.join(derived(spark, sf_dir, "SELECT doc_id FROM labels"), "doc_id", "left_semi").select("key")
    from formweave.sources.files import not_yet_done

    return not_yet_done(files, done).select("doc_id", "key")


@query("""
SELECT 'c_name' AS "column", least(greatest(max(length(c_name)), 6) + 2, 42) AS width FROM customer UNION ALL SELECT 'c_mktsegment', least(greatest(max(length(c_mktsegment)), 12) + 2, 42) FROM customer
UNION ALL SELECT 'long', least(greatest(max(length(c_name || c_name || c_name)), 4) + 2, 42) FROM customer""")
def sheet_widths(spark, sf_dir):
    c = derived(spark, sf_dir, "SELECT c_name, c_mktsegment, c_name || c_name || c_name AS long FROM customer")
    return rows.sheet_widths(c, c.columns).withColumn("width", F.col("width").cast("long"))


SHEETS = "SELECT p_partkey AS pos, CASE WHEN p_size = 1 THEN ' [*] ' WHEN p_size % 2 = 0 THEN upper(p_name) || '/' || p_type ELSE p_name || ': a rather long name of a sheet' END AS name FROM part"


@query(f"""
WITH c AS (SELECT pos, name, substr(trim(regexp_replace(name, '[\\\\/?*\\[\\]:]', '', 'g')), 1, 31) AS base FROM ({SHEETS}) s), b AS (SELECT pos, name, CASE WHEN base = '' THEN 'Sheet' ELSE base END AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY pos) AS n FROM b)
SELECT pos, name, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 31 - length(' (' || n || ')')) || ' (' || n || ')' END AS sheet FROM n""")
def sheet_names(spark, sf_dir):
    return rows.sheet_names(derived(spark, sf_dir, SHEETS))


IDS = "SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '0' || CAST(p_size AS STRING) ELSE CAST(p_partkey * 7919 % 1000 AS STRING) END AS ID FROM part"


@query(f"""SELECT pos, "ID", row_number() OVER (ORDER BY CASE WHEN regexp_matches("ID", '^[0-9]+$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches("ID", '^[0-9]+$') THEN CAST("ID" AS BIGINT) END NULLS FIRST, pos) AS place FROM ({IDS}) i""")
def row_sort(spark, sf_dir):
    return rows.numbered_rows(derived(spark, sf_dir, IDS), "pos")


@query(f"SELECT form_id, field, contains({collapse_('t')}, {collapse_('expected')}) AS present FROM (SELECT f.form_id, field, expected, {SCAN_TEXT} AS t FROM ({FIELDS}) f JOIN ({SCANS}) s ON f.form_id = s.form_id) x")
def value_presence(spark, sf_dir):
    both = derived(spark, sf_dir, f"SELECT form_id, t, stack({len(KEYS)}, {', '.join(f"'{k}', {k}" for k in KEYS)}) AS (field, expected) FROM (SELECT *, {SCAN_TEXT} AS t FROM ({SCANS}) s) x")
    return both.select("form_id", "field", F.contains(text.collapse(F.col("t")), text.collapse(F.col("expected"))).alias("present"))


ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
CELLS = " || ".join(f"'<td>' || {ESC(c)} || '</td>'" for c in ("serial", "field", "expected", "found", "status"))


@query(f"SELECT form_id, md5('<h2>Form ' || form_id || '</h2><table>' || string_agg('<tr>' || {CELLS} || '</tr>', '' ORDER BY pos) || '</table>') AS html FROM ({RESULTS}) r GROUP BY form_id")
def html_report(spark, sf_dir):
    results = statuses(spark, sf_dir).withColumn("label", F.col("field"))
    return rows.report_lines(results).select("form_id", F.md5(F.col("html").cast("binary")).alias("html"))


# Pages of the store's records: a table with a heading, a row that lacks its opening tag, and a key given twice; and a list of users.
RECORD_PAGES = f"""
SELECT form_id AS page_id, '<table id="t"><tr><th>No</th><th>Field</th><th>Value</th></tr><tr><td>1</td><td>Record No</td><td><b>' || record_no || '</b></td></tr> <td>2</td><td>Holder Name</td><td> ' || replace(ph_name, '#', ' &amp; ') || ' </td></tr><tr><td>3</td><td>Premium</td><td>0$</td></tr><tr><td colspan="2">note</td></tr><TR class="x"><td>4</td><td>PREMIUM</td><td>' || premium || '</td><td>more</td></TR></table>' AS html, record_no, ph_name, premium FROM ({RECORDS}) r"""
USER_PAGES = """
SELECT n_nationkey AS page_id, '<select><option value="selectuser">pick one</option><option value="">none</option><OPTION selected value="u' || CAST(n_nationkey AS STRING) || '"><i>' || n_name || '</i> &lt;1&gt;</OPTION>' || CASE WHEN n_regionkey = 1 THEN '<option class="b" value="v">A&nbsp;B</option>' ELSE '' END || '</select>' AS html, n_name, n_regionkey FROM nation"""


@query(f"""SELECT page_id, unnest(['record_no', 'holder_name', 'premium']) AS key, unnest([record_no, replace(ph_name, '#', ' & '), premium]) AS value FROM ({RECORD_PAGES}) p""")
def html_records(spark, sf_dir):
    """Key and value of the tables of record pages."""
    return html.key_values(derived(spark, sf_dir, RECORD_PAGES).select("page_id", "html")).select("page_id", F.explode("record").alias("key", "value"))


@query(f"""SELECT page_id, 2 AS n, 'u' || page_id AS value, n_name || ' <1>' AS text FROM ({USER_PAGES}) p UNION ALL SELECT page_id, 3, 'v', 'A B' FROM ({USER_PAGES}) p WHERE n_regionkey = 1""")
def html_options(spark, sf_dir):
    """Users that may be chosen on a page."""
    return html.options(derived(spark, sf_dir, USER_PAGES).select("page_id", "html"))


UNREAD = "SELECT s_suppkey AS folder, 1 AS pos, 0.5D AS col, 'p<' || CAST(s_suppkey AS STRING) || '>.png' AS image, s_suppkey % 3 AS box, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'L_I@' || CAST(10000 + s_suppkey AS STRING) || ' & ' || s_name || ' TR12AN34SA56CT' END AS text FROM supplier"


@query(f"""SELECT folder || ':1' AS form_id, '<h2>Form ' || folder || ':1</h2><p>Image: ' || {ESC('image')} || ' | Form #' || (box + 1) || '</p><p>NOT MAPPED</p><p>' || '{rows.UNMATCHED}' || '</p>' ||
  CASE WHEN text = '' THEN '' ELSE '<h3>Text read from the form</h3><pre>' || {ESC('text')} || '</pre>' END AS html FROM ({UNREAD.replace('0.5D', '0.5')}) u""")
def html_unmatched(spark, sf_dir):
    """Reports of forms whose number belongs to no record."""
    whole = forms.merged_forms(derived(spark, sf_dir, UNREAD))
    named = matching.match_by_number(whole.select(F.col("form_id").alias("id"), "text"), derived(spark, sf_dir, RECORDS)).where("record_no is null")
    unread = whole.join(named.select(F.col("id").alias("form_id")), "form_id")
    return rows.unmatched_report(unread.select("form_id", "image", F.element_at("members", -1)["box"].alias("box"), "text"))


def filled_(where: str) -> str:
    return f"CASE WHEN trim(found) = '' AND {where} THEN expected ELSE found END"


@query(f"""SELECT form_id, field, {filled_('true')} AS shown, {filled_("status = 'mismatch' AND trim(expected) <> ''")} AS found, CASE WHEN trim(found) = '' AND status = 'mismatch' AND trim(expected) <> '' THEN 'match' ELSE status END AS status
FROM (SELECT form_id, field, expected, found, CASE WHEN status = 'ocr_missed' AND form_id % 2 = 0 THEN 'mismatch' ELSE status END AS status FROM ({RESULTS}) r) r""")
def filled_fields(spark, sf_dir):
    """The optional fallback for values that were not read, in both of its forms (half of the missed ones count as wrong here)."""
    results = statuses(spark, sf_dir).withColumn("status", F.when((F.col("status") == "ocr_missed") & (F.col("form_id") % 2 == 0), "mismatch").otherwise(F.col("status")))
    shown = verdict.filled(results, keep_status=True).select("form_id", "field", F.col("found").alias("shown"))
    return verdict.filled(results).select("form_id", "field", "found", "status").join(shown, ["form_id", "field"])


@query(f"""SELECT page, box, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + w AS DOUBLE) AS x1, CAST(y + h AS DOUBLE) AS y1, x + w / 2.0 AS cx, y + h / 2.0 AS cy, x / 0.5 AS sx, (y + h) / 0.5 AS sy, round((x + w / 2.0) / 1000, 9) AS place,
  greatest(0, x - 4) AS px0, greatest(0, y - 4) AS py0, least(1000, x + w + 4) AS px1, least(1400, y + h + 4) AS py1 FROM ({NUMBERED}) b""")
def box_geometry(spark, sf_dir):
    """Corners and centres of outlines, boxes at another scale, places on the page and padded crops."""
    boxes = derived(spark, sf_dir, NUMBERED)
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    out = boxes.withColumn("b", layout.bounding_box(F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))))
    out = out.withColumns({"s": layout.rescaled(F.array("b"), F.lit(0.5))[0], "p": layout.clamped(x, y, w, h, F.lit(1000), F.lit(1400))})
    crop = [F.col(f"p.{c}").cast("int").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")]
    return out.select("page", "box", "b.x0", "b.y0", "b.x1", "b.y1", "b.cx", "b.cy", F.col("s.x0").alias("sx"), F.col("s.y1").alias("sy"), F.round(layout.column_place(x, w, F.lit(1000)), 9).alias("place"), *crop)


@query(f"""SELECT c.key, c.on_form, coalesce(x.read, 0) AS read, coalesce(x.blank, 0) AS blank FROM (VALUES {", ".join(f"('{f[0]}', {str(f[3]).lower()})" for f in CATALOG)}) c(key, on_form)
LEFT JOIN (SELECT field, count(*) FILTER (found <> '') AS read, count(*) FILTER (found = '') AS blank FROM ({FIELDS}) f GROUP BY field) x ON c.key = x.field""")
def catalog_counts(spark, sf_dir):
    """How often each field of the catalog was read on scans, and how often it was blank there."""
    count = lambda c: F.sum(c.cast("long"))
    of = derived(spark, sf_dir, FIELDS_ONCE).groupBy(F.col("field").alias("key")).agg(count(F.col("found") != "").alias("read"), count(F.col("found") == "").alias("blank"))
    return field_catalog(spark).join(of, "key", "left").select("key", "on_form", F.coalesce("read", F.lit(0).cast("long")).alias("read"), F.coalesce("blank", F.lit(0).cast("long")).alias("blank"))


STREAMED = BY_COLUMN.replace("SELECT a.folder,", "SELECT CAST(a.folder AS VARCHAR) AS folder,").replace("SELECT folder, pos, md5(text), 'open'", "SELECT CAST(folder AS VARCHAR), pos, md5(text), 'open'")


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of forms, and an end mark for each folder."""
    parts = derived(spark, sf_dir, PARTS).select(F.col("folder").cast("string").alias("folder"), "pos", "text", F.col("col").cast("double").alias("col"))
    return parts, parts.groupBy("folder").agg((F.max("pos") + 1).alias("pos")).select("folder", "pos", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("col"))


def stitched_stream(spark: SparkSession, base: str, batches: list[DataFrame], carry: DataFrame | None = None) -> DataFrame:
    """The stitching stream over files of batches that come one after the other (a folder's rows of one in one file)."""
    from formweave.streaming.carry import stitch_stream

    for rows_ in batches:
        rows_.repartition("folder").write.mode("append").parquet(f"{base}/in")
    # each round visits all state partitions, so large inputs come in larger rounds instead of more of them
    files = len(spark.read.schema(batches[0].schema).parquet(f"{base}/in").inputFiles())
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", max(4, -(-files // 12))).parquet(f"{base}/in")
    run = stitch_stream(stream, carry).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema("folder string, pos long, text string, state string").parquet(f"{base}/out")


@query(STREAMED)
def stream_carry(spark, sf_dir):
    """The stitching stream over files of turns, read back as a table (a test compares it with the batch)."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parts, end = turns(spark, sf_dir)
    out = stitched_stream(spark, base, [parts.where("pos < 2"), parts.where("pos >= 2"), end])
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"SELECT folder, text, state FROM ({STREAMED}) s")
def carry_handover(spark, sf_dir):
    """Two streams: the first stops with halves open, the second begins with them. Together they are the one stream."""
    from formweave.streaming.carry import left_open

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parts, end = turns(spark, sf_dir)
    first = stitched_stream(spark, f"{base}/1", [parts.where("pos < 1"), parts.where("pos between 1 and 2")])
    second = stitched_stream(spark, f"{base}/2", [parts.where("pos > 2"), end], left_open(spark, f"{base}/1/state"))
    return first.unionByName(second).select("folder", F.md5(F.col("text").cast("binary")).alias("text"), "state")


@query(f"SELECT folder, text, state FROM ({BY_COLUMN}) s")
def batch_handover(spark, sf_dir):
    """Two batches of turns: the second begins with the halves that the first leaves open."""
    parts = derived(spark, sf_dir, PARTS)
    early, late = parts.where("pos <= 2"), parts.where("pos > 2")
    first = stitch.stitch_by_column(stitch.classify(early)).where("state <> 'open'")
    second = stitch.stitch_by_column(stitch.classify(stitch.with_carry(late, stitch.open_halves(early))))
    return first.unionByName(second).select("folder", F.md5(F.col("text").cast("binary")).alias("text"), "state")
