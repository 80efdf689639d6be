"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on. AQE coalesces the small shuffles of the
# evaluation jobs and splits skewed join partitions; the broadcast threshold is left at
# Spark's default. Explicit broadcasts hold tables of fixed or bounded size only.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "triplematch") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TRIPLEMATCH_DRIVER_MEMORY", "16g"))
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is configured by the operator and only read here; without one this
    raises, as a machine-local folder would not survive a lost executor. Only a local master (tests)
    gets a fresh scratch folder, so checkpoint() works there too.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the server side owns the checkpoint folder
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return conf_dir
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="triplematch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: survives executor loss, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: computed once, and smaller than a checkpoint."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str, spread_on: str | None = None) -> DataFrame:
    """Read one driver table. ``spread_on``: see :func:`spread_small_input`."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small_input(df, spread_on) if spread_on else df


def spread_small_input(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute a scan that yields fewer splits than the cluster has cores.

    Text work (tokenising, decoding, scoring) costs CPU per row; a small file stored as one row
    group is read by one task. The split count is known at planning time (no job runs). A large
    input already has enough splits and is returned unchanged, so no shuffle is added at scale.
    """
    try:
        sc = df.sparkSession.sparkContext
        target = sc.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a remote session): leave the plan as it is
        return df
    if splits >= target:
        return df
    return df.repartition(target, key)
