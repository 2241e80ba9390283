import random

from formweave.operators.ordered import in_blocks, numbered, running
from formweave.operators.rows import numbered_rows
from pyspark.sql import functions as F


def test_running_values_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(-5, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = in_blocks(df, ["g"], ["i"])
        assert blocks.where("g = 'hot'").select("_block").distinct().count() > 3
        for how, start, step in ((F.sum, 0, lambda a, v: a + v), (F.min, 99, min), (F.max, -99, max)):
            got = {r.i: r.x for r in running(blocks, ["i"], F.col("v"), "x", how).collect()}
            for g in ("hot", "a", None):
                acc = start
                for h, i, v in rows:
                    if h == g:
                        acc = step(acc, v)
                        assert got[i] == acc
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("t")).repartition(6)
    got = numbered(df, ["k"]).collect()
    assert sorted((r.k, r.place) for r in got) == [(i, i + 1) for i in range(5000)]
    assert numbered(df.where("false"), ["k"]).count() == 0
    ids = spark.createDataFrame([("b", 1), ("10", 2), ("9", 3), (None, 4), ("010", 5), ("a", 6)], "ID string, pos int")
    assert [r.ID for r in numbered_rows(ids, "pos").orderBy("place").collect()][:3] == ["9", "10", "010"]
    assert numbered_rows(ids, "pos").count() == 6
