"""Partition folders, through the file system Spark itself uses."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def partitions(spark: SparkSession, path: str) -> dict[str, str]:
    """``name=value`` sub-folders of a folder: value -> full path."""
    files, folder = _open(spark, path)
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and "=" in name:
            found[name.split("=", 1)[1]] = status.getPath().toString()
    return found


def drop(spark: SparkSession, path: str) -> None:
    files, folder = _open(spark, path)
    files.delete(folder, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    files, folder = _open(spark, path)
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def read_text(spark: SparkSession, path: str) -> str:
    files, file = _open(spark, path)
    stream = files.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text in one step, unless it exists; says whether it did.

    The text is written beside it and put in place by a move that never replaces
    anything. The file system must do that in one step, as HDFS and local ones do.
    """
    files, target = _open(spark, path)
    files.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    try:
        if files.getUri().getScheme() == "file":
            return _linked(draft.toUri().getPath(), target.toUri().getPath())
        return _moved(spark, files.makeQualified(draft), files.makeQualified(target))
    finally:
        files.delete(draft, False)


def _linked(draft: str, target: str) -> bool:
    try:
        os.link(draft, target)
    except FileExistsError:
        return False
    return True


def _moved(spark: SparkSession, draft, target) -> bool:
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(options, 0))
    except Py4JJavaError as failure:
        if "FileAlreadyExists" not in str(failure.java_exception):
            raise
        return False
    return True
