"""Scratch tables."""

from inkwright.llm import common


def test_scratch_is_written_read_and_cleared(spark):
    df = common.materialize(spark.range(5), "t")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4] and "/scratch/t-" in df.inputFiles()[0]
    common.drop_scratch(df)
    again = common.materialize(spark.range(2), "t")
    common.clear_scratch(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(again.inputFiles()[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert common.unused(spark.range(1).toDF("A"), "a") == "_a"
