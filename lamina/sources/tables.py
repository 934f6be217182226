"""Tables that a later step reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by each application, oldest first.
FOLDERS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir; it goes when the application ends, if not before (see discard).

    A local folder is made only where the session names none and runs in one process, as in tests; a cluster that names none is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-lamina-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/lamina-{uuid.uuid4().hex}"
    store, path = file_system(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def file_system(spark: SparkSession, uri: str):  # noqa: ANN201
    """Hadoop's file system and path of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession) -> list[str]:
    """The folders that shared_dir() has made for this application and that are still there."""
    return list(FOLDERS.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, gone: list[str]) -> None:
    """Deletes folders made by shared_dir(): tables in them can't be read any more."""
    for folder in gone:
        store, path = file_system(spark, folder)
        store.delete(path, True)
        FOLDERS[spark.sparkContext.applicationId].remove(folder)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and no executor's loss takes it away."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
