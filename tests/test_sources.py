"""Curve forms and run tables."""

from pyspark.sql import functions as F

from wavelens.sources import curves as source


def test_forms_agree(spark):
    rows = [(1, 1, 1.0), (1, 3, 2.0), (2, 1, 5.0), (2, 2, 6.0), (2, 3, None)]
    points = spark.createDataFrame(rows, "curve_id long, x int, y double")
    held = source.packed(points.where("y is not null"), spark.createDataFrame([(1, 4), (2, 3)], "curve_id long, len int"))
    assert {r.curve_id: r.y for r in held.collect()} == {1: [1.0, None, 2.0, None], 2: [5.0, 6.0, None]}
    again = source.from_arrays(held, "curve_id", "y").where("y is not null")
    assert sorted(map(tuple, again.collect())) == [r for r in rows if r[2] is not None]
    wide = source.to_wide(points, [1, 2])
    long = source.from_wide(wide, "x", ["1", "2"]).where("y is not null").select(F.col("curve_id").cast("long"), "x", "y")
    assert sorted(map(tuple, long.collect())) == [r for r in rows if r[2] is not None]


def test_runs_are_read_by_directory_and_resumed(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    grid = source.run_grid(spark, [2, 3], [61, 51], 2)
    assert grid.count() == 8
    source.write_run(grid.where("run_id <= 3").withColumn("seconds", F.lit(1.0)), path)
    assert sorted(r.run_id for r in source.pending(grid, spark.read.parquet(path)).collect()) == [4, 5, 6, 7, 8]
    one = source.read_runs(spark, path, K=[2], c=[51])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "clusters" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.run_id for r in one.collect()) == [3]
