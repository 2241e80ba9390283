import random
import time
from collections import Counter

from formweave.operators.stitch import by_column, classify, group_members, open_halves, stitch_by_column, stitch_in_order, stretches, with_carry
from formweave.streaming.carry import carry_table, left_open, normal_carry, stitch_stream
from pyspark.sql import functions as F

START, WHOLE, REST = "@ 12345 top", "L_I@12345 all C-1234567", "bottom half"


def parts(seed=0, folders=12):
    rng = random.Random(seed)
    out = []
    for f in range(folders):
        for pos in range(rng.randint(1, 14)):
            kind = rng.choice([START, START, WHOLE, REST, REST, "", "  "])
            out.append((f"f{f}", pos, f"{kind} {pos}" if kind.strip() else kind, rng.choice([0.2, 0.25, 0.75, 0.8, None])))
    return out


def queue(rows):
    out = []
    for folder in sorted({r[0] for r in rows}):
        held = []
        for _, pos, text, _ in sorted(r for r in rows if r[0] == folder):
            if not text.strip():
                continue
            if text.startswith("@"):
                held.append((pos, text))
            elif text.startswith("L_I"):
                out.append((folder, pos, text, "complete"))
            elif held:
                out.append((folder, pos, held.pop(0)[1] + " " + text, "joined"))
            else:
                out.append((folder, pos, text, "orphan"))
        out += [(folder, p, t, "open") for p, t in held]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "folder string, pos long, text string, col double")


def test_windows_equal_a_queue(spark):
    for seed in range(2):
        rows = parts(seed, 40)
        got = stitch_in_order(classify(frame(spark, rows))).select("folder", "pos", "text", "state").collect()
        assert Counter(map(tuple, got)) == queue(rows)


def test_by_column_takes_the_nearest_first(spark):
    kinds = {"@": "partial", "L": "complete", "b": "continuation"}
    ready, left = by_column([(0, "@a", 0.2, "partial"), (1, "@b", 0.8, "partial"), (2, "b", 0.7, "continuation"), (3, "c", None, "continuation"), (4, "d", 0.1, "continuation")], [])
    assert ready == [(2, "@b b", "joined"), (3, "@a c", "joined"), (4, "d", "orphan")] and left == []
    assert by_column([(2, "x", 0.5, "continuation")], [(0, "@a", 0.4), (1, "@b", 0.6)])[0] == [(2, "@a x", "joined")]
    rows = parts(3)
    got = Counter(map(tuple, stitch_by_column(classify(frame(spark, rows))).collect()))
    want = Counter()
    for f in {r[0] for r in rows}:
        mine = [(p, t, c, kinds[t[0]]) for g, p, t, c in sorted(rows, key=lambda r: r[1]) if g == f and t.strip()]
        ready, left = by_column(mine, [])
        want.update((f, *x) for x in ready)
        want.update((f, p, t, "open") for p, t, _ in left)
    assert got == want


def test_groups_keep_blank_parts(spark):
    rows = [("a", 0, START, 0.2), ("a", 1, "", 0.2), ("a", 2, REST, 0.3), ("a", 3, None, None), ("a", 4, WHOLE, 0.5)]
    got = {r.pos: r.group_pos for r in group_members(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    rows = parts(5)
    df = frame(spark, rows)
    want = Counter(map(tuple, stitch_by_column(classify(df)).collect()))
    end = df.groupBy("folder").agg((F.max("pos") + 1).alias("pos")).select("folder", "pos", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("col"))
    for n, cuts in enumerate((["pos < 100"], ["pos < 3", "pos between 3 and 5", "pos > 5"])):
        base = f"{tmp_path}/{n}"
        for c in cuts:
            df.where(c).coalesce(1).write.mode("append").parquet(f"{base}/in")
        end.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run = stitch_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
        assert Counter(map(tuple, spark.read.parquet(f"{base}/out").select("folder", "pos", "text", "state").collect())) == want


def test_carry_accepts_old_and_new_entries():
    assert normal_carry(["a", ["b", 0.2], ["c"], ["d", None]]) == [(-4, "a", 0.5), (-3, "b", 0.2), (-2, "c", 0.5), (-1, "d", 0.5)]


def streamed(spark, df, base, cuts, carry=None, timeout=None, ends=False):
    """Runs the stream over the cuts of df; gives its rows and what it leaves open."""
    for c in cuts:
        df.where(c).coalesce(1).write.mode("append").parquet(f"{base}/in")
    if ends:
        end = df.groupBy("folder").agg((F.max("pos") + 1).alias("pos")).select("folder", "pos", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("col"))
        end.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = stitch_stream(stream, carry, timeout).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema("folder string, pos long, text string, state string").parquet(f"{base}/out"), left_open(spark, f"{base}/state")


def test_streams_hand_open_halves_on(spark, tmp_path):
    rows = parts(8, 9)
    df = frame(spark, rows)
    want = Counter(map(tuple, stitch_by_column(classify(df)).collect()))
    first, carry = streamed(spark, df, f"{tmp_path}/1", ["pos < 2", "pos between 2 and 4"])
    assert Counter(r.folder for r in carry.collect()) == Counter(r.folder for r in open_halves(df.where("pos <= 4")).collect())
    second, left = streamed(spark, df.where("pos > 4"), f"{tmp_path}/2", ["pos < 8", "pos >= 8"], carry)
    got = Counter((r.folder, r.text, r.state) for r in first.union(second).collect()) + Counter((r.folder, r.text, "open") for r in left.collect())
    assert got == Counter((f, t, s) for (f, _, t, s), n in want.items() for _ in range(n))


def test_batches_hand_open_halves_on(spark):
    df = frame(spark, parts(8, 9))
    want = Counter((r.folder, r.text, r.state) for r in stitch_by_column(classify(df)).collect())
    first = stitch_by_column(classify(df.where("pos <= 4"))).where("state <> 'open'")
    second = stitch_by_column(classify(with_carry(df.where("pos > 4"), open_halves(df.where("pos <= 4")))))
    assert Counter((r.folder, r.text, r.state) for r in first.union(second).collect()) == want


def test_a_carry_alone_is_flushed_by_an_end_mark_or_by_silence(spark, tmp_path):
    carry = carry_table(spark, {"a": ["@ 11111 x", ["@ 22222 y", 0.9]], "b": [["@ 33333 z", None]]})
    end = spark.createDataFrame([("a", 5, None, None)], "folder string, pos long, text string, col double")
    got, left = streamed(spark, end, f"{tmp_path}/1", ["true"], carry)
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [("a", -2, "@ 11111 x", "open"), ("a", -1, "@ 22222 y", "open")]
    assert [tuple(r) for r in left.collect()] == [("b", -1, "@ 33333 z", 0.5)]


def test_silent_folders_are_flushed(spark, tmp_path):
    carry = carry_table(spark, {"a": ["@ 11111 x", ["@ 22222 y", 0.9]]})
    spark.createDataFrame([("a", 1, "rest", 0.8)], "folder string, pos long, text string, col double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("folder string, pos long, text string, col double").parquet(f"{tmp_path}/in")
    run = stitch_stream(stream, carry, 50).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    got, until = set(), time.time() + 60
    while len(got) < 2 and time.time() < until:
        time.sleep(1)
        if run.recentProgress:
            got = {tuple(r) for r in spark.read.schema("folder string, pos long, text string, state string").parquet(f"{tmp_path}/out").collect()}
    run.stop()
    # what came first depends on the clock: the timer of the carry, or the row
    assert got in ({("a", 1, "@ 22222 y rest", "joined"), ("a", -2, "@ 11111 x", "open")}, {("a", -1, "@ 22222 y", "open"), ("a", -2, "@ 11111 x", "open"), ("a", 1, "rest", "orphan")})


def slow_by_column(rows):
    """One folder in order, with a list that is searched whole."""
    out, held = [], []
    for pos, text, col, kind in rows:
        col = 0.5 if col is None else col
        if kind == "partial":
            held.append((pos, text, col))
        elif kind == "continuation" and held:
            out.append((pos, held.pop(min(range(len(held)), key=lambda k: abs(held[k][2] - col)))[1] + " " + text, "joined"))
        else:
            out.append((pos, text, "orphan" if kind == "continuation" else "complete"))
    return out, held


def test_search_by_column_equals_a_scan():
    rng = random.Random(2)
    for columns in ([0.1, 0.2, 0.3, 0.5], [0.25, 0.75, None], [rng.random() for _ in range(300)]):
        rows = [(i, f"t{i}", rng.choice(columns), rng.choice(["partial", "partial", "continuation", "complete"])) for i in range(800)]
        assert by_column(rows, []) == slow_by_column(rows)


def test_one_folder_is_cut_into_stretches(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small blocks would become one
    try:
        rows = [("all", i, rng.choice([START, START, REST, REST, REST]) + f" {i}", rng.choice([0.2, 0.4, 0.8, None])) for i in range(3000)] + [(None, 1, START, 0.1), (None, 2, REST, 0.1)]
        kinds = classify(frame(spark, rows))
        cut = stretches(kinds.where("kind <> 'complete'"))
        assert cut.where("folder = 'all'").select("stretch").distinct().count() > 100 and cut.count() == len(rows)
        want, left = slow_by_column([(p, t, c, "partial" if t[0] == "@" else "continuation") for f, p, t, c in rows if f])
        got = Counter(map(tuple, stitch_by_column(kinds).collect()))
        assert got == Counter([("all", *x) for x in want] + [("all", p, t, "open") for p, t, _ in left] + [(None, 2, f"{START} {REST}", "joined")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
