"""Incremental runs: new files only, and a rerun with nothing new changes nothing."""

import tempfile

from pyspark.sql import functions as F

from kernelspark.streaming import incremental as INC


def test_incremental_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="ks-stream-test-")
    src, out, ck = f"{root}/landing", f"{root}/out", f"{root}/ckpt"
    df = spark.range(0, 100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    df.filter("id < 50").write.parquet(f"{src}/a")

    def agg(b):
        return b.groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    assert INC.run_incremental(spark, f"{src}/*", df.schema, out, ck, agg) >= 1
    df.filter("id >= 50").write.parquet(f"{src}/b")
    assert INC.run_incremental(spark, f"{src}/*", df.schema, out, ck, agg) >= 1
    first = sorted(spark.read.parquet(out).groupBy("g").agg(F.sum("n").alias("n")).collect())
    assert sum(r.n for r in first) == 100
    assert INC.run_incremental(spark, f"{src}/*", df.schema, out, ck, agg) == 0     # nothing new
    again = sorted(spark.read.parquet(out).groupBy("g").agg(F.sum("n").alias("n")).collect())
    assert again == first
