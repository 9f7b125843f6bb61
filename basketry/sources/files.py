"""The cluster's view of files: listing, heads of text files and small text files, through Spark's Hadoop file systems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop path and file system of ``path``, whatever the scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time in ms) of what lies directly in a folder; none if it is absent."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]


def data_files(spark: SparkSession, paths: str | Iterable[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the visible files of files, folders or patterns, as Spark's readers take them."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        p, fs = file_system(spark, path)
        todo = list(fs.globStatus(p) or [])
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += [c for c in fs.listStatus(s.getPath()) if not c.getPath().getName().startswith(("_", "."))]
            else:
                found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def first_lines(spark: SparkSession, path: str, more) -> str:
    """The first line of a text file, and further ones as long as ``more(text)`` holds; '' for an empty file."""
    jvm = spark.sparkContext._jvm
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        text = reader.readLine()
        while text is not None and more(text):
            line = reader.readLine()
            if line is None:
                break
            text += "\n" + line
        return text or ""
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    p, fs = file_system(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    p, fs = file_system(spark, path)
    q, _ = file_system(spark, to)
    if not fs.rename(p, q):
        raise OSError(f"could not rename {path} to {to}")


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)
