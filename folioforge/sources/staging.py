"""Intermediate results in the folder that all executors share, and what lies in folders of any file system."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Only a local master, which has one machine, gets an own one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root, True)
    return root


def _located(spark: SparkSession, path: str):
    """The path and its file system, for the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder, on whatever file system that is; what is put there is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    place, system = _located(spark, path)
    system.deleteOnExit(place)
    return path


def is_file(spark: SparkSession, path: str) -> bool:
    place, system = _located(spark, path)
    return system.exists(place) and system.getFileStatus(place).isFile()


def folders(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """The folders name=value below a path, by their value."""
    place, system = _located(spark, f"{path.rstrip('/')}/{name}=*")
    found = system.globStatus(place)
    return {x.getPath().getName().partition("=")[2]: x.getPath().toString() for x in found or [] if x.isDirectory()}


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
