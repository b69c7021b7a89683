"""Folders of a file system that Spark knows: listing, dropping, and small files that change all at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    _, where, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all in it."""
    _, where, fs = _fs(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over what was there: readers see the old text or the new."""
    jvm, where, _ = _fs(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    beside = where.suffix(".new")
    create, rename = (jvm.java.lang.Class.forName(f"org.apache.hadoop.fs.{c}").getEnumConstants() for c in ("CreateFlag", "Options$Rename"))
    flags = jvm.java.util.EnumSet.of(create[0], create[1])  # create or overwrite
    out = context.create(beside, flags, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0))
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = rename[1]
    context.rename(beside, where, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or null where there is none."""
    _, where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
