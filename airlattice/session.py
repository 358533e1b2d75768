"""Session construction and the few session-level settings the library depends on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every plan in the library relies on: UTC wall clock (readings are epoch
# seconds), AQE for runtime re-planning (coalescing, skew-join splitting, runtime
# broadcast conversion of data-derived small sides whose size AQE measures itself).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "airlattice", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    On a cluster the caller passes its own master and partition count; the defaults
    here are sized for local tests.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(CORE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("AIRLATTICE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(key, conf[key])
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application.

    Functions that run inside tasks import it there, wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_airlattice_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="airlattice-py-"), "airlattice_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("airlattice", os.path.relpath(full, home)))
    context.addPyFile(archive)
    context._airlattice_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is only filled in here when unset, as in
    local tests, where a fresh scratch folder is taken. On any other master an unset
    folder is an error: executors on several hosts would each write their own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        current = tempfile.mkdtemp(prefix="airlattice-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system that holds ``path`` remove it when the application ends (results
    that are still lazy may read it until then)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut_lineage(df):
    """Materialise ``df`` as parquet under the shared checkpoint folder and read it back.

    One job writes it (a reliable RDD checkpoint would compute the data twice unless
    cached); the returned frame's plan starts at those files, so it survives the loss
    of any executor and stops the plan from growing in iterative loops. The folder is
    removed when the application ends.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
