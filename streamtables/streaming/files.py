"""Numbered output folders on the cluster's file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder, so that a stream can watch it before its first file is written."""
    fs, target = _folder(spark, path)
    fs.mkdirs(target)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the sub-folders ``b=<n>`` whose write was committed, in order."""
    fs, target = _folder(spark, path)
    if not fs.exists(target):
        return []
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/b=*/_SUCCESS"))
    return sorted(int(m.getPath().getParent().getName().removeprefix("b=")) for m in marks)


def folder_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of what matches a path pattern."""
    fs, target = _folder(spark, pattern)
    return sorted(found.getPath().getName() for found in fs.globStatus(target) or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _folder(spark, path)
    fs.delete(target, True)


def write_numbered(df: DataFrame, path: str, number: int, format: str = "parquet", by: str | None = None) -> None:
    """Write one numbered folder, with a sub-folder for each value of ``by``. Writing the same number again replaces it."""
    writer = df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(by) if by else writer).format(format).save(f"{path}/b={number}")


def read_numbered(spark: SparkSession, path: str, numbers: list[int], base: str | None = None) -> DataFrame:
    """The rows of numbered folders; with their common folder as ``base`` also their number ``b``."""
    reader = spark.read.option("basePath", base) if base else spark.read
    return reader.parquet(*[f"{path}/b={n}" for n in numbers])
