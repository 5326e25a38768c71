from credlens.functions.sizing import ensure_checkpoint_dir, is_small, spread


def test_only_inputs_with_few_splits_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, 100, 1, 1)
    many = spark.range(0, 100, 1, cores * 2)
    assert spread(few, "id").rdd.getNumPartitions() == cores * 2
    assert "Exchange" not in spread(many, "id")._jdf.queryExecution().executedPlan().toString()


def test_is_small(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    wide = spark.range(10).selectExpr("repeat('x', 1000) AS path")
    assert is_small(wide, 10) and not is_small(wide, 10, max_bytes=9_999)
    assert is_small(wide.where("false"), 10)


def test_checkpoint_dir_of_the_session_is_kept(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert first and spark.sparkContext.getCheckpointDir() == first
