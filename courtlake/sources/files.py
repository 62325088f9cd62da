"""Small text files in any store that Spark can reach, through its own file system classes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder)))


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes or replaces a file."""
    stream = _fs(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Puts the text there unless there is a file already; whole or not at all. False if another was first.

    The text is written under another name and renamed without overwriting, which file systems like HDFS do in one step.
    """
    draft = f"{path}.{spark._jvm.java.util.UUID.randomUUID().toString()}.draft"
    write_text(spark, draft, text)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, draft), _path(spark, path), plain)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        delete(spark, draft)
        return False


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def rename(spark: SparkSession, path: str, to: str) -> None:
    if not _fs(spark, path).rename(_path(spark, path), _path(spark, to)):
        raise OSError(f"{path} could not be renamed to {to}")


def local(spark: SparkSession, path: str) -> str | None:
    """The path on the file system that executors and driver have in common, if that is where it is; None in other stores."""
    if _fs(spark, path).getUri().getScheme() != "file":
        return None
    return _path(spark, path).toUri().getPath()


def state(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of change of a file, or of the files of a folder."""
    if not exists(spark, path):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in _fs(spark, path).listStatus(_path(spark, path)))


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether anything is there, by name or pattern."""
    found = _fs(spark, pattern).globStatus(_path(spark, pattern))
    return found is not None and len(found) > 0
