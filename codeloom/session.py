"""Session settings and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", partitions: int = 8, app: str = "codeloom", more: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=more or {})
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package along with the application, once, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codeloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or a temporary one where it is unset and the session is local.

    On a cluster a folder of the driver's machine isn't shared, so an unset one is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="codeloom-"))
    return "file://" + _OWN_DIR[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which `drop_written` deletes."""
    _WRITTEN.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Unlike `checkpoint()` this computes the plan once, not twice, and the copy outlives lost executors.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables made by `written`; call it when no result that reads them is needed any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
