import json

import pytest
from formweave.catalog import KEYS
from formweave.operators import records
from formweave.sources import files, html, sinks, snapshots, xlsx
from pyspark.sql import functions as F


def test_snapshots(spark, tmp_path):
    assert snapshots.read_records(spark, None).count() == 0
    (tmp_path / "default.json").write_text(json.dumps([{"record_no": "1", "x": None, "n": 5}]))
    path = snapshots.active_snapshot(spark, str(tmp_path), "default.json")
    assert path.endswith("default.json") and snapshots.active_snapshot(spark, str(tmp_path), "none.json") is None
    assert snapshots.read_records(spark, path).first().raw == {"record_no": "1", "x": "", "n": "5"}
    for stamp in ("20240101_000000", "20231231_235959"):
        (tmp_path / f"scraped_{stamp}.json").write_text(json.dumps([{"record_no": stamp}, {"policy_holder_name": "Ann", "ph_name": "hidden"}]))
    rows = snapshots.read_records(spark, snapshots.active_snapshot(spark, str(tmp_path), "default.json"))
    assert [r.raw.get("record_no") for r in rows.orderBy("pos").collect()] == ["20240101_000000", None]
    aligned = records.align_schema(rows).orderBy("pos").collect()
    assert aligned[1].ph_name == "Ann" and aligned[1].record_no is None and len(aligned[0]) == len(KEYS) + 1
    for stamp in ("20240102_000000", "20240103_000000"):
        snapshots.write_snapshot(rows.withColumn("raw", F.create_map(F.lit("s"), F.lit(stamp))), str(tmp_path / "table"), stamp)
    assert {r.raw["s"] for r in snapshots.read_snapshot(spark, str(tmp_path / "table")).collect()} == {"20240103_000000"}


def test_workbooks_round_trip(spark, tmp_path):
    body = [[" Record No ", "Policy Holder Name", "unknown", "PH_ZIP", "ph_zip"], ["L_I@1", "Ánn <&> \"Lee\"", "x", "1", 97301], [None, None, None, None, None], ["L_I@2", "", "", "", 3.5]]
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook(body))
    (tmp_path / "b.xlsx").write_bytes(xlsx.workbook([["ID", "PH City"], ["7", "Reno"]]))
    (tmp_path / "c.xlsx").write_bytes(xlsx.workbook([["PH City"], ["Reno"]]))
    got = {(r.sheet[-6], r.pos): r for r in xlsx.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)}
    assert got["a", 0].ph_name == 'Ánn <&> "Lee"' and got["a", 0].ph_zip == "97301" and got["a", 1].ph_zip == "3.5"
    assert got["b", 0].record_no == "7" and got["b", 0].ph_city == "" and got["a", 0].ph_city == ""
    assert [xlsx.column_number(xlsx.column_letters(n)) for n in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
    df = spark.createDataFrame([("s1", i, f"v{i}", float(i)) for i in range(5)], "sheet string, pos long, a string, b double")
    books = {r.part: bytes(r.content) for r in xlsx.as_workbooks(df, "sheet", "pos", most=3).collect()}
    assert sorted(books) == [0, 1] and list(xlsx.sheet_cells(books[1])) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "v3"), (1, 1, "3.0"), (2, 0, "v4"), (2, 1, "4.0")]


def test_exports(spark, tmp_path):
    raw = spark.createDataFrame([(0, {"record_no": "1", "zz": "a"}), (1, {"policy_holder_name": "Ann", "yy": 'q"u,o', "zz": "b"})], "pos long, raw map<string,string>")
    extras = [r.key for r in records.extra_columns(raw).orderBy("place").collect()]
    assert extras == ["zz", "yy"]
    table = records.export_table(raw, extras)
    for write, sep in ((sinks.write_csv, ","), (sinks.write_tsv, "\t")):
        write(table.coalesce(1), str(tmp_path / "out"))
        back = spark.read.option("header", True).option("sep", sep).option("escape", '"' if False else "\\").csv(str(tmp_path / "out")).collect()
        assert back[0]["Record No"] == "1" and back[1]["Policy Holder Name"] == "Ann" and back[1]["yy"] == 'q"u,o'
    sinks.write_json(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


PAGE = """<table id="sampleTable"><tr><td><a href="viewform.php?id=1">x</a></td><td><a class='c' href='viewform.php?id=2'>y</a><a href="other">z</a></td></tr></table><a href="viewform.php?id=3">out</a>
<select><option value="">-</option><option value="selectuser">Select</option><option value="u1"> Ann &amp; Co </option></select>"""
FORM = """<table><tr><td>No</td><td>Field</td><td>Value</td></tr><tr><td>24</td><td>Weight</td><td> 150 </td></tr>
 <td>25</td><td>Blood Group</td><td>O+</td></tr><tr><td>26</td><td>Policy No</td></tr><tr><td>27</td><td>Policy <b>No</b></td><td>P&lt;1</td></tr><tr><td>28</td><td>policy no</td><td>last</td><td>more</td></tr></table>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "no table"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.url) for r in html.links(df, "viewform.php?id=", "https://x.example/", "sampleTable").orderBy("n").collect()] == [(1, "https://x.example/viewform.php?id=1"), (1, "https://x.example/viewform.php?id=2")]
    assert html.links(df, "viewform.php?id=", "https://x.example/").count() == 3
    assert [(r.value, r.text) for r in html.options(df).collect()] == [("u1", "Ann & Co")]
    form = spark.createDataFrame([(1, FORM), (2, "")], "page_id long, html string")
    got = {r.page_id: r.record for r in html.key_values(form).collect()}
    assert got == {1: {"weight": "150", "blood_group": "O+", "policy_no": "last"}, 2: {}}


def test_images_and_their_results(spark, tmp_path):
    for name in ("a.PNG", "sub/b.jpeg", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = files.image_files(spark, str(tmp_path))
    assert found.count() == 2
    done = files.not_yet_done(found, spark.createDataFrame([], "key string"))
    read = files.recognise(done, lambda: lambda b: (b.decode(), [(0.0, 1.0, 2.0, 3.0)]))
    assert sorted(r.text for r in read.collect()) == ["a.PNG", "sub/b.jpeg"]
    assert files.not_yet_done(found, read.limit(1)).count() == 1


def test_upserts_and_lookups(spark):
    store = spark.createDataFrame([(0, "L_I@61001", "a"), (1, "L_I@61002", "b"), (2, "L_I@61002", "c")], "pos long, record_no string, value string")
    new = spark.createDataFrame([(0, " L_I@61002", "new"), (1, "X", "end"), (2, " ", "none"), (3, "X", "end2"), (4, None, "none")], "pos long, record_no string, value string")
    got = [(r.record_no, r.value) for r in records.upsert(store, new).orderBy("pos").collect()]
    assert got == [("L_I@61001", "a"), (" L_I@61002", "new"), ("L_I@61002", "c"), ("X", "end2")]
    asked = spark.createDataFrame([(" l_i@61002 ",), ("61001",), ("i@6100",), ("nope",), ("",)], "key string")
    got = {r.key: (r.found, r.tier) for r in records.lookup(store, asked).collect()}
    assert got == {" l_i@61002 ": ("L_I@61002", 1), "61001": ("L_I@61001", 2), "i@6100": ("L_I@61001", 2), "nope": (None, None), "": (None, None)}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_stores(spark, n):
    store = spark.createDataFrame([(0, "a", "x")][:n], "pos long, record_no string, value string")
    new = spark.createDataFrame([(0, "b", "y")], "pos long, record_no string, value string")
    assert records.upsert(store, new).count() == n + 1


def test_pages_are_taken_apart_once(spark):
    page = "<tr><th>x</th></tr><tr><td>1</td><td>A b</td><td>1</td></tr><tr><td>2</td><td>A B</td><td>2</td></tr>"
    out = html.key_values(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).select("page_id", F.explode("record").alias("key", "value"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "a_b", "2")]


def test_lookup_deals_substrings_without_their_records(spark):
    """Only the place of a substring's first record is shuffled with it; equal places do not mix up records."""
    store = spark.createDataFrame([(5, "L_I@61001"), (5, "X_9"), (1, None), (7, "L_I@61002")], "pos long, record_no string")
    asked = spark.createDataFrame([("i@6100",), ("x_",), ("61002",), ("zz",)], "key string")
    out = records.lookup(store, asked)
    parts = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [part" in line]
    assert parts and not any("min_by" in line or "found" in line for line in parts)
    assert {r.key: (r.found, r.tier) for r in out.collect()} == {"i@6100": ("L_I@61001", 2), "x_": ("X_9", 2), "61002": ("L_I@61002", 2), "zz": (None, None)}
