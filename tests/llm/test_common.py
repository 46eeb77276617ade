import time

from cuewright.llm.common import materialise
from cuewright.sources.tables import Tables
from pyspark.sql import functions as F


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    dealt = [spark.range(1000).withColumn("k", F.col("id") % 7 + n).repartition(3, "k") for n in range(2)]
    tables = Tables(spark, "test")
    held = materialise(dealt[0], "test"), tables.write(dealt[1], "rows")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(key) == setting
    # what was written is read from the table, and the frames themselves can be evaluated again
    assert [df.count() for df in (*held, *dealt)] == [1000] * 4
    tables.drop()
