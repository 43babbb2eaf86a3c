"""Written tables."""

import time

from lodewatch.llm.shared import settle


def test_shuffles_go_once_the_table_is_written(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = kept()
    settle(spark.range(1000).repartition(4, "id"))
    until = time.time() + 10
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert not kept() - before
