"""Small driver-side file operations on whatever store holds a table.

They touch folder names, markers and short lists only; rows are read and written
by Spark jobs.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it does not exist."""
    fs, place = file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty marker file."""
    fs, place = file_system(spark, path)
    fs.create(place, True).close()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole, or return False because it is there already.

    The text is written beside the file and renamed to it; a rename that must not
    replace anything is one step, so readers and other writers see all or nothing.
    """
    jvm = spark._jvm
    fs, place = file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
