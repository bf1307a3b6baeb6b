"""Names that one writer can take: a file in a folder, created once. They order pushes and use up approvals.

On the local file system a claim is a hard link and elsewhere a rename that never replaces, so of several writers one
takes the name. On stores whose renames are copies (S3) let one writer push at a time.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _store(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder and its path; None and a local path for the local file system."""
    to = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (None, Path(to.toUri().getPath())) if fs.getUri().getScheme() == "file" else (fs, to)


def names(spark: SparkSession, folder: str) -> set[str]:
    """The names taken in a folder."""
    fs, to = _store(spark, folder)
    if fs is None:
        found = os.listdir(to) if to.is_dir() else []
    else:
        found = [s.getPath().getName() for s in fs.listStatus(to)] if fs.exists(to) else []
    return {n for n in found if not n.startswith(".")}


def claim(spark: SparkSession, folder: str, name: str | int, text: str) -> bool:
    """Takes a name, with a text behind it; False if another has it. Numbers are padded, so they sort as names."""
    name = f"{name:020d}" if isinstance(name, int) else name
    fs, to = _store(spark, folder)
    held = f".{uuid.uuid4().hex}"
    if fs is None:
        to.mkdir(parents=True, exist_ok=True)
        (to / held).write_text(text)
        try:
            os.link(to / held, to / name)
        except FileExistsError:
            return False
        finally:
            (to / held).unlink()
        return True
    jvm = spark._jvm
    path = lambda n: jvm.org.apache.hadoop.fs.Path(to, n)
    out = fs.create(path(held))
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    try:
        context.rename(path(held), path(name), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(path(held), False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The greatest number taken and its text; 0 and None if there is none."""
    last = max(names(spark, folder), default=None)
    if last is None:
        return 0, None
    fs, to = _store(spark, folder)
    if fs is None:
        return int(last), (to / last).read_text()
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(to, last))
    try:
        return int(last), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
