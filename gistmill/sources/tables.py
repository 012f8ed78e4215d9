"""Parquet tables of one directory, and the shared folder for data that outlives a stage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Gives this package's code to the executors' Python workers, once per context, wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_gistmill_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="gistmill-code-")) / "gistmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._gistmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, of a scan, in at least as many partitions as tasks run at once: small files have few row groups, and work in Python takes long for each row.

    Large tables have more partitions than that and stay as they are; results don't depend on it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (as tests do) a temporary folder is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gistmill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as parquet into the shared folder and reads it back; this cuts its lineage. :func:`clear_staged` deletes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gistmill-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    context = spark.sparkContext
    if not hasattr(context, "_gistmill_staged"):
        context._gistmill_staged = []
    context._gistmill_staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Deletes what :func:`staged` has written in this session, once its results have been used; how many folders went."""
    context = spark.sparkContext
    paths, context._gistmill_staged = getattr(context, "_gistmill_staged", []), []
    for path in paths:
        _delete(spark, path)
    return len(paths)


def drop_staged(df: DataFrame) -> None:
    """Deletes what :func:`staged` has written for ``df``, once nothing that is still to run reads it."""
    names = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    paths = df.sparkSession.sparkContext._gistmill_staged
    for path in [p for p in paths if p.rsplit("/", 1)[-1] in names]:
        _delete(df.sparkSession, path)
        paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
