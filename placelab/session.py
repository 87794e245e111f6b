"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "placelab", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for local masters."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="placelab-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/placelab-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a parquet table in the checkpoint folder and read back, without its lineage.

    It survives the loss of executors, later reads prune columns, and the planner
    knows true sizes before it picks a broadcast join. ``discard`` removes it.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._placelab_path = path
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over tasks, evenly or by ``keys``, for work that is heavy per row.

    A file's rows may all come in one task, and shuffles of few bytes are put together into few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder wherever it is stored; nothing happens if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_placelab_path", None)
        if path:
            delete(table.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Remove every table that this application has materialized; for the end of a job."""
    delete(spark, _folder(spark))


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; their Python path need not hold it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="placelab-ship-"), "placelab.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped[app] = archive
