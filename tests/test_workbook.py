"""The workbook data source: round trips, partitions, and writes that fail."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.staging import fresh_path
from lodestone.sources import faq, workbook

SCHEMA = "sheet string, row int, cells array<string>"


def test_round_trip(spark):
    workbook.register(spark)
    cells = [["a", None, "c"], [], [None], ["<&>\"'", " kept ", "x\x0by\r\nz\t", "_x0041_ _", "한국어 \U0001f600"], ["v"] * 30]
    rows = [(s, k + 2, c) for s in ("one", "two & <three>") for k, c in enumerate(cells)]
    path = fresh_path(spark, "books")
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.coalesce(1).sortWithinPartitions("sheet", "row").write.format("workbook").mode("append").save(path)
    found = spark.read.format("workbook").load(path)
    assert found.rdd.getNumPartitions() == 2  # one a sheet
    plain = lambda c: c[: max((k + 1 for k, x in enumerate(c) if x is not None), default=0)]
    assert sorted((r["sheet"], r["row"], r["cells"]) for r in found.collect()) == sorted((s, k, plain(c)) for s, k, c in rows)
    # The other reader knows the format too.
    assert {(r["sheet"], r["row"]) for r in faq.read_workbooks(spark, path).collect()} == {(s, k) for s, k, _ in rows}


def test_a_failed_write_leaves_no_file(spark):
    workbook.register(spark)
    path = fresh_path(spark, "books")
    good = spark.range(8).select(F.lit("s").alias("sheet"), (F.col("id") + 1).cast("int").alias("row"), F.array(F.lit("x")).alias("cells")).repartition(4)
    bad = good.withColumn("cells", F.when(F.col("row") == 5, F.array(F.raise_error(F.lit("lost")).cast("string"))).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="lost"):
        bad.sortWithinPartitions("sheet", "row").write.format("workbook").mode("append").save(path)
    where = path.removeprefix("file://")
    # A task that is killed as the write ends may leave something in its own folder, which no reader looks into.
    left = lambda: [f for f in (os.listdir(where) if os.path.isdir(where) else ()) if not f.startswith("_temporary")]
    assert left() == []
    with pytest.raises(Exception, match="comes after"):
        good.coalesce(1).sortWithinPartitions(F.desc("row")).write.format("workbook").mode("append").save(path)
    assert left() == []
    assert spark.read.format("workbook").load(path).count() == 0
