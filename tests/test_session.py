"""Session helpers: sizing and the reliable checkpoint directory."""

from riskloom.session import cluster_conf, ensure_checkpoint_dir, materialize


def test_cluster_conf_scales_partitions():
    small = cluster_conf(10 << 30)
    big = cluster_conf(100 * 10 ** 12)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 100_000
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "256m"


def test_checkpoint_dir_and_materialize(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    df = spark.range(100).withColumnRenamed("id", "x")
    m = materialize(df.where("x % 2 = 0"))
    assert m.count() == 50
    assert "InMemoryTableScan" not in m._jdf.queryExecution().executedPlan().toString()
