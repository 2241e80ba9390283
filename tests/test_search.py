import random

from formweave.operators import search
from pyspark.sql import functions as F


def test_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(1)
    names = ["Ann Lee", "BOB ray", "Zoë Ünal", "anna banana", "aaa aaaa", None, ""]
    rows = [(3 * i, f"L_I@{60000 + i}" if i % 9 else None, rng.choice(names), rng.choice([f"F{i}", None])) for i in range(400)]
    records = spark.createDataFrame(rows, "pos long, record_no string, ph_name string, form_no string")
    search.write_index(records, str(tmp_path))
    texts = {p: " ".join(x or "" for x in r).lower() for p, *r in rows}
    for typed in ("ann", "a", "an", "ana", "anana", "aaaa", " aa aa ", "L_I@600", "60012", "zoë ü", "nothing here", "@", "f39", "lee f1", "e", ""):
        needle = typed.strip().lower()
        want = [p for p, t in sorted(texts.items()) if needle in t]
        assert [r.pos for r in search.search_index(spark, str(tmp_path), typed).collect()] == want[:60]
        if needle:
            assert sorted(r.pos for r in search.positions(spark, str(tmp_path), needle).collect()) == want
    assert [r.pos for r in search.search_index(spark, str(tmp_path), "l_i@", limit=3).collect()] == [3, 6, 9]


def test_plans_read_what_they_need(spark, tmp_path):
    records = spark.range(500).select(F.col("id").alias("pos"), F.concat(F.lit("L_I@"), F.col("id")).alias("record_no"), F.lit("n").alias("ph_name"), F.lit(None).cast("string").alias("form_no"))
    search.write_index(records, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().toString()
    of = plan(search.positions(spark, str(tmp_path), "l_i@49"))
    assert "PartitionFilters: [bucket" in of.replace("PartitionFilters: [isnotnull(bucket#", "PartitionFilters: [bucket") and "In(gram" in of
    assert "StringStartsWith(gram" in plan(search.positions(spark, str(tmp_path), "l_"))
    assert "PushedFilters: [In(pos" in plan(search.search_index(spark, str(tmp_path), "l_i@49"))


def test_empty_stores(spark, tmp_path):
    none = spark.createDataFrame([], "pos long, record_no string, ph_name string, form_no string")
    search.write_index(none, str(tmp_path))
    for typed in ("", "a", "abcd"):
        assert search.search_index(spark, str(tmp_path), typed).count() == 0


def test_postings_get_more_ranges_when_there_are_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SORTED", 100)
    rows = [(i, f"L_I@{60000 + i}", f"Name {i}", f"F{i}") for i in range(100)]
    store = spark.createDataFrame(rows, "pos long, record_no string, ph_name string, form_no string")
    search.write_index(store, str(tmp_path / "index"))
    files = {p.name.split("-")[1] for p in (tmp_path / "index" / "postings").glob("bucket=*/part-*.parquet")}
    assert len(files) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r.pos for r in search.search_index(spark, str(tmp_path / "index"), "name 7").collect()] == [7, *range(70, 80)]
