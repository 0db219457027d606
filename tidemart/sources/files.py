"""Hadoop file system access from the driver: listings and header lines only, never data."""

from __future__ import annotations

import csv
import fnmatch
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, from the file system's own records."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since the epoch."""
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced as a whole."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file written by ``write_text``."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(full path, bytes) of the files a pattern names."""
    fs, p = _fs(spark, pattern)
    return [(s.getPath().toString(), s.getLen()) for s in fs.globStatus(p) or [] if s.isFile()]


def set_modified(spark: SparkSession, path: str, seconds: int) -> None:
    fs, p = _fs(spark, path)
    fs.setTimes(p, seconds * 1000, -1)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is directory) of the visible entries, by name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            out.append((name, status.getPath().toString(), status.isDirectory()))
    return sorted(out)


def data_files(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """Files under the entries of ``root`` that match ``pattern``; an entry may be a folder, of any depth."""
    found: list[str] = []
    left = [(path, is_dir) for name, path, is_dir in children(spark, root) if fnmatch.fnmatch(name, pattern)]
    while left:
        path, is_dir = left.pop()
        if is_dir:
            left += [(p, d) for _, p, d in children(spark, path)]
        else:
            found.append(path)
    return sorted(found)


def header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> tuple[str, ...]:
    """Column names in the first line of one file, decompressing it if its suffix says so."""
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    codec = codecs.getCodec(p)
    raw = codec.createInputStream(stream) if codec is not None else stream
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw, encoding))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    if line is None:
        return ()
    return tuple(next(csv.reader([line.lstrip("﻿")], delimiter=sep), []))


def headers(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "UTF-8"):
    """Header of every file, read by a few driver threads (one small read per file)."""
    with ThreadPoolExecutor(max_workers=32) as pool:
        return list(pool.map(lambda p: header(spark, p, sep, encoding), paths))
