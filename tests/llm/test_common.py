import os

from loomspark.llm import common


def test_least_hashes_is_a_stable_sample(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = [r.k for r in common.least_hashes(df, "k", 500).collect()]
    assert len(a) == 500 and a == [r.k for r in common.least_hashes(df.repartition(7), "k", 500).collect()]
    assert common.least_hashes(df.limit(3), "k", 500).count() == 3 and common.least_hashes(df.limit(0), "k", 5).count() == 0


def test_tables_are_written_once_and_cleaned_up(spark):
    df = common.materialize(spark.range(10))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 10 and os.path.exists(path)
    common.clean_up(spark)
    assert not os.path.exists(path)


def test_a_written_table_leaves_no_shuffle_files(spark):
    from loomspark.llm.common import materialize

    def blocks():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum("shuffle" in b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folders.getAllBlocks()))

    before = blocks()
    made = materialize(spark.range(1000).groupBy("id").count())
    assert blocks() <= before
    assert made.count() == 1000
