"""Session helpers: a sensible local session, and shipping the package to Python workers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def get_spark(app: str = "kinmark", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application, whatever their PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*") if p.suffix in (".py", ".npz") and "__pycache__" not in p.parts)
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = os.path.abspath(os.path.join(tempfile.mkdtemp(prefix="kinmark-code-"), f"kinmark_{digest}.zip"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else (only in a
    single-JVM ``local`` session) a temporary folder, else the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="kinmark-")
        return f"file://{_LOCAL[app]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


#: Spark's own switch: the shuffle files of a command are removed as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors. The
    shuffles of the write go when it has ended; the folder goes when the application's driver ends (a reader of a
    lazy result may need it until then)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of ``stored`` tables before the driver ends, once nothing can read them again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Hadoop's own registry: the file system deletes the folder when the driver's JVM shuts down."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores (one small file, whose row group is one task) is dealt
    out over all of them; any other is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
