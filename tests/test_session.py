"""Row-group spreading, freed shuffles, dropped tables."""

import os

from casegrain.session import FREES_SHUFFLES, drop_path, freed_shuffles, materialize, spread


def _scan(spark, path, rows, files, block=None):
    w = spark.range(rows).withColumnRenamed("id", "x").repartition(files).write
    (w.option("parquet.block.size", block) if block else w).parquet(path)
    return spark.read.parquet(path)


def test_only_scans_with_fewer_row_groups_than_cores_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    one = spread(_scan(spark, str(tmp_path / "one"), 1000, 1))
    assert "RoundRobinPartitioning" in one._jdf.queryExecution().toString() and one.count() == 1000
    many = spread(_scan(spark, str(tmp_path / "many"), 1000, cores))
    assert "RoundRobinPartitioning" not in many._jdf.queryExecution().toString()
    groups = spread(_scan(spark, str(tmp_path / "groups"), 400_000, 1, 64 * 1024))      # one file, many row groups
    assert "RoundRobinPartitioning" not in groups._jdf.queryExecution().toString()


def test_written_tables_free_and_drop(spark, tmp_path):
    before = spark.conf.get(FREES_SHUFFLES, "false")
    out = materialize(spark.range(100).repartition(3), "freed")
    assert out.count() == 100 and spark.conf.get(FREES_SHUFFLES, "false") == before
    with freed_shuffles(spark):
        assert spark.conf.get(FREES_SHUFFLES) == "true"
    path = str(tmp_path / "t")
    out.write.parquet(path)
    drop_path(spark, path)
    assert not os.path.exists(path)
