from takeoff.session import configure


def test_parts_of_a_task_are_bounded(spark):
    conf = configure(spark)._jsparkSession.sessionState().conf()
    assert conf.filesMaxPartitionBytes() <= 32 << 20
    parts = spark.range(0, 4_000_000, 1, 8).selectExpr("sha2(cast(id as string), 256) as k")  # some 270 MB that don't compress
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert parts.repartition("k").groupBy("k").count().rdd.getNumPartitions() >= 10  # 4 cores would take parts of 64 MB
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
