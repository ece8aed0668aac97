"""Numbered versions in a folder, which of them is current, and how one is added.

Every version is a small file under ``versions``, named by its number; the highest one
is current. A file is written under another name first and gets its own only if nobody
has it, in one step of the file system, so of two writers that both saw number 7 one
makes number 8 and the other is told. Numbers, not clocks, order versions.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Version:
    number: int
    name: str
    details: dict = field(default_factory=dict)


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there; those that Spark hides are left out."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    found = (status.getPath().getName() for status in files.listStatus(place))
    return sorted(name for name in found if not name.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def _folder(directory: str) -> str:
    return f"{directory.rstrip('/')}/versions"


def _text(spark: SparkSession, path: str) -> str:
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Whether a file of this name was made; not if there is one."""
    files, target = _at(spark, f"{folder}/{name}")
    _, draft = _at(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = files.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if files.getScheme() == "file":
            os.link(_local(files, draft), _local(files, target))
        else:
            jvm = spark._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                target.toUri(), spark._jsc.hadoopConfiguration()
            )
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(files.makeQualified(draft), files.makeQualified(target), options)
        return True
    except Exception:
        if files.exists(target):
            return False
        raise
    finally:
        files.delete(draft, False)


def _local(files: JavaObject, place: JavaObject) -> str:
    return files.makeQualified(place).toUri().getPath()


def listed(spark: SparkSession, directory: str) -> list[int]:
    """The numbers there are, rising."""
    return [int(name) for name in children(spark, _folder(directory)) if name.isdigit()]


def version(spark: SparkSession, directory: str, number: int) -> Version:
    held = json.loads(_text(spark, f"{_folder(directory)}/{number:012d}"))
    return Version(number, held["name"], held["details"])


def current(spark: SparkSession, directory: str) -> Version | None:
    """The version with the highest number, or None where there is none."""
    numbers = listed(spark, directory)
    return version(spark, directory, numbers[-1]) if numbers else None


def commit(
    spark: SparkSession, directory: str, name: str, after: int, details: dict | None = None
) -> bool:
    """Add the version that follows number ``after``; False if another one did already."""
    text = json.dumps({"name": name, "details": details or {}})
    return _create(spark, _folder(directory), f"{after + 1:012d}", text)


def add(spark: SparkSession, directory: str, name: str, details: dict | None = None) -> int:
    """Add a version that does not depend on the one before it; returns its number."""
    while True:
        numbers = listed(spark, directory)
        last = numbers[-1] if numbers else 0
        if commit(spark, directory, name, last, details):
            return last + 1


def forget(spark: SparkSession, directory: str, keep: int) -> list[Version]:
    """Take all but the last ``keep`` versions off the list; returns those taken off.

    What they hold is the caller's to remove, as versions may share files.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    old = [version(spark, directory, number) for number in listed(spark, directory)[:-keep]]
    for gone in old:
        remove(spark, f"{_folder(directory)}/{gone.number:012d}")
    return old
