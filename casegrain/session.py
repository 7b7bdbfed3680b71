"""Session helpers: building a session, reading the test tables, shared folders.

Work that must survive executor loss (lineage cuts, written intermediate
tables) goes under the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent (local tests) do we pick one ourselves.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "casegrain",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    # Unset: local tests only.  A cluster always names a shared folder.
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="casegrain-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def _row_groups(spark: SparkSession, files: list[str]) -> int:
    """Row groups of a few Parquet files, from their footers."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    n = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            n += reader.getRowGroups().size()
        finally:
            reader.close()
    return n


def spread(df: DataFrame) -> DataFrame:
    """Rows of a Parquet scan over all cores, where its row groups alone would leave cores idle.

    A row group is read by one task, however many byte ranges Spark cuts the file into. A
    scan with a file per core is left as it is, without looking at a footer; so is one
    with a row group per core. Neither case shuffles, so big inputs never do; and no row changes.
    """
    spark, cores = df.sparkSession, df.sparkSession.sparkContext.defaultParallelism
    files = df._jdf.inputFiles()        # stays in the JVM: only a few names come over
    if not len(files) or len(files) >= cores or _row_groups(spark, list(files)) >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries begun inside delete their shuffle files when they end: for writes, whose result is complete by then."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
