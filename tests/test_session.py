import os

from pyspark.sql import functions as F

from packetflow.session import Scratch


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        if (name := files.next().getName()).startswith("shuffle_"):
            found.add(name)
    return found


def test_kept_tables_leave_no_shuffle_files_and_go_when_over(spark):
    before = shuffled(spark)
    with Scratch(spark) as scratch:
        first = scratch.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        second = scratch.keep(first.join(first.groupBy("k").agg(F.sum("count").alias("s")), "k"), first)
        root = scratch.root.removeprefix("file:")
        assert not os.path.exists(f"{root}/1") and os.path.exists(f"{root}/2") and shuffled(spark) <= before
        assert second.count() == 7 and spark.conf.get(scratch._CLEANUP) == "false"
    assert not os.path.exists(root)
