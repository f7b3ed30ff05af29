"""Small files on any file system Spark reads: listing, reading, atomic writing."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """(name, path, bytes, modification time) of the files of a folder, or of one file."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return [(f.getPath().getName(), f.getPath().toString(), f.getLen(), f.getModificationTime())
            for f in fs.listStatus(p) if f.isFile()]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file or, after a failure, what was there before: written beside its
    place under a name that readers skip, and put there by one rename."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(p), rename)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, False)
