"""Versioned folders: a folder counts once its write is complete.

A Spark write leaves ``_SUCCESS`` behind when its job commits, so a folder without that
file is the rest of a write that failed, and readers do not see it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_hadoop_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def complete_versions(spark: SparkSession, parent: str, name: str) -> list[int]:
    """Numbers of the complete folders ``<parent>/<name>=<number>``, ascending."""
    pattern = _hadoop_path(spark, f"{parent}/{name}=*/_SUCCESS")
    found = _file_system(spark, parent).globStatus(pattern)
    folders = [status.getPath().getParent().getName() for status in found or []]
    numbers = [re.fullmatch(rf"{re.escape(name)}=([0-9]+)", folder) for folder in folders]
    return sorted(int(number[1]) for number in numbers if number)


def write_version(df: DataFrame, parent: str, name: str, number: int, replace: bool = True) -> str:
    """Write ``df`` as one version, replacing an earlier write of the same number if allowed.

    What a failed write left behind is always replaced.
    """
    path = f"{parent}/{name}={number}"
    spark = df.sparkSession
    if not replace and number not in complete_versions(spark, parent, name):
        delete(spark, path)
    (
        df.write.mode("overwrite" if replace else "errorifexists")
        .option("compression", "zstd")
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        .parquet(path)
    )
    return path


def write_version_in_parts(parts: Iterable[DataFrame], parent: str, name: str, number: int) -> str:
    """Write several tables as one version, which is complete when the last one is."""
    path, first = f"{parent}/{name}={number}", True
    for df in parts:
        if first:
            delete(df.sparkSession, path)
        (
            df.write.mode("append")
            .option("compression", "zstd")
            .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            .parquet(path)
        )
        spark, first = df.sparkSession, False
    _file_system(spark, path).create(_hadoop_path(spark, f"{path}/_SUCCESS")).close()
    return path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    return _file_system(spark, path).getContentSummary(_hadoop_path(spark, path)).getLength()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    if not exists(spark, path):
        return []
    found = _file_system(spark, path).listStatus(_hadoop_path(spark, path))
    return sorted(status.getPath().getName() for status in found)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _file_system(spark, path).open(_hadoop_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text; false if there is one of this name already.

    Of several writers that do so at once, one creates the file. On a local file system the text
    is written aside and linked to the name; elsewhere it is renamed without overwriting, which
    HDFS does in one step. A store without such a rename is safe for one writer only.
    """
    parent, name = path.rsplit("/", 1)
    aside = f"{parent}/.{name}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path), _hadoop_path(spark, path)
    stream = system.create(_hadoop_path(spark, aside), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if system.getScheme() == "file":
            file = spark._jvm.java.io.File
            source = file(system.resolvePath(_hadoop_path(spark, aside)).toUri().getPath()).toPath()
            link = source.resolveSibling(name)
            spark._jvm.java.nio.file.Files.createLink(link, source)
        else:
            rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            never = spark.sparkContext._gateway.new_array(rename, 1)
            never[0] = rename.valueOf("NONE")
            context = spark._jvm.org.apache.hadoop.fs.FileContext
            context.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(
                _hadoop_path(spark, aside), target, never
            )
        return True
    except Py4JJavaError as error:
        if not exists(spark, path):
            raise
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        delete(spark, aside)
