import os

import pytest
from pyspark.sql import functions as F

from formweave.llm.common import discard, exact_rank, keep, shared_dir
from formweave.llm.components import connected_components
from formweave.llm.repeats import sharing


def test_kept_tables_stand_in_the_shared_folder_until_discarded(spark):
    one = keep(spark.range(5), "t")
    assert one._kept_at.startswith(shared_dir(spark)) and one.count() == 5 and os.path.isdir(one._kept_at)
    discard(one)
    assert not os.path.exists(one._kept_at)


def test_a_cluster_needs_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_sharing_finds_equal_keys_across_partitions(spark):
    rows = [(i % 7 if i % 3 else 1000 + i, i) for i in range(400)] + [(5, 3), (5, 3)]
    df = spark.createDataFrame(rows, "k long, pos long")
    got = sorted(map(tuple, sharing(df, ["k"], ["pos"]).collect()))
    assert got == sorted((k, p) for k, p in rows if k < 1000)
    text = df.select(F.col("k").cast("string").cast("binary").alias("k"), "pos")
    assert sharing(text.repartition(9), ["k"], ["pos"]).count() == len(got)
    assert sharing(df.limit(0), ["k"], ["pos"]).count() == 0


def test_ranks_and_components(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id")
    ranked = exact_rank(df, ["g"], [F.col("id")], F.col("id"), rows=1 << 31).collect()
    for g in (0, 1):
        assert sorted(r.before for r in ranked if r.g == g) == list(range(150))
    chain = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.component) for r in connected_components(chain).collect()} == {(i, 0) for i in range(51)}
