"""Folder names and removal on the file system a path belongs to."""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _open(spark, path)
    return system.exists(target)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches a pattern."""
    system, target = _open(spark, pattern)
    return bool(system.globStatus(target))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Files at any depth below a path; names with _ or . before them are hidden."""
    system, target = _open(spark, path)
    found: list[str] = []
    waiting = [target] if system.exists(target) else []
    while waiting:
        for entry in system.listStatus(waiting.pop()):
            if entry.getPath().getName()[:1] in "_.":
                continue
            if entry.isDirectory():
                waiting.append(entry.getPath())
            else:
                found.append(entry.getPath().toString())
    return sorted(found)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path."""
    system, target = _open(spark, path)
    if not system.exists(target):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(target) if entry.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    system, target = _open(spark, path)
    system.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _open(spark, path)
    system.mkdirs(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a path."""
    system, target = _open(spark, path)
    if not system.exists(target):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _open(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with its whole content in one step; False, and nothing made, if it exists.

    It is written beside its place and renamed without leave to overwrite.
    """
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    hadoop = jvm.org.apache.hadoop.fs
    folder, name = path.rsplit("/", 1)
    make_folder(spark, folder)
    system, draft = _open(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)  # noqa: SLF001
    plain[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(hadoop.Path(path)), plain)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def set_age(spark: SparkSession, path: str, seconds: int) -> None:
    """Date a file so many seconds after the first day of 2000."""
    system, target = _open(spark, path)
    system.setTimes(target, (946_684_800 + seconds) * 1000, -1)
