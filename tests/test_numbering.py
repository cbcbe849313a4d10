"""Dense numbers: gap-free, in order, independent of the partitioning, safe for huge groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.functions.numbering import dense_ids, number_within


@pytest.fixture
def slices(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n_slices", [1, 3, 17])
def test_dense_ids(spark, slices, n_slices):
    slices(n_slices)
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = dense_ids(df, ["k"], "id", start=11).collect()
    assert {r.k: r.id for r in rows} == {k: k + 11 for k in range(5000)}


def test_dense_ids_put_null_last(make):
    rows = dense_ids(make("k int", (None,), (2,), (1,)), ["k"]).collect()
    assert {r.k: r.id for r in rows} == {1: 1, 2: 2, None: 3}


def test_dense_ids_of_nothing(make):
    assert dense_ids(make("k int"), ["k"]).count() == 0


@pytest.mark.parametrize("n_slices", [1, 8, 31])
def test_number_within_a_huge_group(spark, slices, n_slices):
    slices(n_slices)
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("g"),
        (F.col("id") * 31 % 6000).alias("o"),
    )
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    got = number_within(df, ["g"], ["o"], "n").select("g", "o", "n")
    assert got.exceptAll(expected).count() == 0
    assert expected.exceptAll(got).count() == 0


def test_number_within_null_key(make):
    df = make("g string, o int", (None, 2), (None, 1), ("a", 5))
    assert {(r.g, r.o): r.sequence for r in number_within(df, ["g"], ["o"]).collect()} == {
        (None, 1): 1, (None, 2): 2, ("a", 5): 1,
    }
