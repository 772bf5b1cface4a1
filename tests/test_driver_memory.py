"""Files and imports are never broadcast: what they take in the driver is not bounded by the size of the files they are read from."""

from pyspark.sql import functions as F

from sparkweft.operators.resolve import meet, resolve_imports


def test_resolution_broadcasts_nothing(spark, tmp_path):
    spark.range(300).select(F.format_string("a/p%d.py", "id").alias("path"), F.lit("python").alias("family")).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    imports = files.select(F.col("path").alias("src"), F.lit("a.p1").alias("module"), "family")
    found = resolve_imports(imports, files)
    assert found.where("dst = 'a/p1.py'").count() == 299
    for rows in (found, meet(imports, files.withColumnRenamed("path", "src"), ["src"])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
