from strataform import workspace


def test_tables_lie_in_the_shared_folder(spark):
    root = workspace.shared_dir(spark)
    table = workspace.staged(spark.range(5), "t")
    assert table.count() == 5 and table.inputFiles()[0].removeprefix("file://").startswith(root.removeprefix("file://").replace("file:", ""))
    workspace.discard(table)
    fs, path = workspace.hadoop(spark, table._staged_path)
    assert not fs.exists(path)
    workspace.discard(spark.range(1))  # what wasn't staged is left alone


def test_spread_keeps_rows_and_enough_parts(spark):
    cores = spark.sparkContext.defaultParallelism
    few = workspace.spread(spark.range(100).coalesce(1))
    assert few.rdd.getNumPartitions() == cores and few.count() == 100
    many = spark.range(100).repartition(cores + 3)
    assert workspace.spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3
    assert workspace.spread(many).count() == workspace.spread(many, heavy=True).count() == 100
