"""Skew-safe numbering, running sums and minima equal plain windows, including a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spooltrace.operators.ranking import row_number_global, row_number_within, running_min_within, running_sum_within


def _data(spark):
    # one group holds a third of all rows; input comes through a shuffle (unordered)
    return (spark.range(0, 30000)
            .selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 11 END AS g",
                        "(id * 7919) % 10007 AS k", "id % 13 AS v")
            .repartition(7))


def test_row_number_global(spark):
    df = _data(spark)
    a = row_number_global(df, ["k", "id"], col="rn", num_partitions=6).select("id", "rn")
    b = df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("rn2"))
    assert a.count() == 30000
    assert a.join(b, "id").where("rn <> rn2").count() == 0


def test_row_number_within_hot_group(spark):
    df = _data(spark)
    a = row_number_within(df, ["g"], ["k", "id"], col="rn", num_partitions=6).select("id", "rn")
    b = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).alias("rn2"))
    assert a.join(b, "id").where("rn <> rn2").count() == 0


def test_running_sum_within(spark):
    df = _data(spark)
    a = running_sum_within(df, ["g"], ["k", "id"], "v", col="rs", num_partitions=6).select("id", "rs")
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    b = df.select("id", F.sum("v").over(w).alias("rs2"))
    assert a.join(b, "id").where("rs <> rs2").count() == 0


def test_running_min_within(spark):
    df = _data(spark).withColumn("v", F.expr("CASE WHEN v > 6 THEN named_struct('a', 100 - id, 'b', id) END"))
    for groups in (["g"], []):
        a = running_min_within(df, groups, ["k", "id"], "v", col="rm", num_partitions=6).select("id", "rm")
        w = Window.partitionBy(*groups).orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
        b = df.select("id", F.min("v").over(w).alias("rm2"))
        assert a.join(b, "id").where("NOT (rm <=> rm2)").count() == 0
    assert running_min_within(df.limit(0), [], ["k"], "v").count() == 0
