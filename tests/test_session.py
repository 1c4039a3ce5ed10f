"""Joins with a counted side: both ways give the same rows, and none copies a side."""

import pytest
from pyspark.sql import functions as F

from edgeloom import session


@pytest.mark.parametrize("how", ["inner", "left"])
def test_counted_join_is_the_same_beyond_its_bound(spark, monkeypatch, how):
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400)
    left = spark.range(3000).select("id", hot.alias("k"))
    small = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    near = session.join_counted(left, small, ["k"], 300, how)
    want = sorted(map(str, near.collect()))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    far = session.join_counted(left, small, ["k"], 300, how)
    assert sorted(map(str, far.collect())) == want
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and far.columns == near.columns


def test_counted_join_of_an_empty_side(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    left, none = spark.range(5).toDF("k"), spark.range(0).toDF("k").withColumn("w", F.lit(1))
    assert session.join_counted(left, none, ["k"], 1).count() == 0
    assert session.join_counted(left, none, ["k"], 1, "left").count() == 5


def test_tables_are_deleted_whichever_way_the_folder_is_named(spark, tmp_path, monkeypatch):
    for folder in (f"{tmp_path}", f"file://{tmp_path}", f"file:{tmp_path}"):
        monkeypatch.setattr(session, "shared_dir", lambda _, folder=folder: folder)
        session.dropped(session.stored(spark.range(5)))
        assert [*tmp_path.iterdir()] == []


def test_a_spanner_leaves_one_table(spark, tmp_path, monkeypatch):
    from edgeloom.operators import cluster

    monkeypatch.setattr(session, "shared_dir", lambda _: f"{tmp_path}")
    e = spark.createDataFrame([(u, v) for u in range(30) for v in range(u + 1, 30) if (u * v) % 3], "u long, v long")
    q = cluster.layered_spanner(e, 3, 1).count()
    t, s = cluster.adaptive_spanner(e, q, 3, 1)
    assert s.count() == q and len([*tmp_path.iterdir()]) == 2
