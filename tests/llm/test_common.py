import os

from pyspark.sql import functions as F

from treegate.llm.common import Workspace, carried, likely, passing, quoted, unpacked, unused, without
from treegate.shared import shared_folder


def test_likely_keeps_every_wanted_row(spark):
    df = spark.range(5000).withColumn("t", F.lit("x"))
    wanted = spark.range(0, 5000, 7)
    kept = {r.id for r in likely(df, wanted, "id").collect()}
    assert {r.id for r in wanted.collect()} <= kept and len(kept) < 1000
    # a bitmap that is nearly full lets all through
    assert likely(df, wanted, "id", bits=7).count() > 4000
    assert likely(df, wanted.where("false"), "id").count() == 0
    assert likely(df, wanted, "id").columns == df.columns


def test_without_is_exact(spark):
    df = spark.range(300).withColumn("doc_id", F.when(F.col("id") > 2, F.col("id")))
    gone = spark.range(0, 300, 3).withColumnRenamed("id", "doc_id")
    for bits in (24, 7):
        left = without(df, gone, "doc_id", bits)
        assert sorted(r.id for r in left.collect()) == [0, 1, 2, *(i for i in range(3, 300) if i % 3)]
    assert without(df, gone.where("false"), "doc_id").count() == 300


def test_written_tables_leave_the_session_as_it_was(spark):
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    work = Workspace(spark, "t")
    assert work.path.startswith(shared_folder(spark))
    out = work.write(spark.range(10), "a")
    assert out.count() == 10 and spark.conf.get(key) == before
    work.delete("a")
    work.write(spark.range(3), "a")
    assert work.read("a").count() == 3


def test_passing_tables_go(spark):
    with passing(spark):
        inner = Workspace(spark, "t")
        kept = Workspace(spark, "t", keep=True)
        rows = (inner.write(spark.range(3), "a").count(), kept.write(spark.range(4), "a").count())
    assert rows == (3, 4) and kept.read("a").count() == 4
    assert not os.path.exists(inner.path.removeprefix("file://"))


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(1, "x", 2, 3, 4)], "doc_id int, text string, `a b` int, `c``d` int, _ int")
    names, packed = carried(df, "A B")
    assert names == ["doc_id", "text", "c`d", "_"] and packed.columns == ["row", "text"]
    assert packed.select(*unpacked(names)).collect() == df.select(*map(quoted, names)).collect()
    assert unused("_", df.columns) == "__" and unused("TEXT", df.columns) == "_TEXT" and unused("n", df.columns) == "n"
