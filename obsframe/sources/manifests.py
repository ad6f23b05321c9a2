"""Small files that name what a table consists of, on any file system Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder; none if there is no such folder."""
    system, where = _system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, folder: str) -> None:
    system, where = _system(spark, folder)
    system.delete(where, True)


def get_text(spark: SparkSession, path: str) -> str | None:
    system, where = _system(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a whole small file and move it to its name in one step. False if ``replace`` is false and the name is taken."""
    folder, _, name = path.rpartition("/")
    system, draft = _system(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else system.getUri(),
                                                                 spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), how)
        return True
    except Exception as error:
        system.delete(draft, False)
        if not replace and "FileAlreadyExistsException" in str(error):
            return False
        raise


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The highest numbered manifest of a folder and its number; (0, {}) if there is none."""
    numbers = [int(n.removesuffix(".json")) for n in names(spark, folder) if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(get_text(spark, f"{folder}/{max(numbers)}.json"))


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make ``content`` the manifest of this number; an error if another writer was first."""
    if not put_text(spark, f"{folder}/{number}.json", json.dumps(content, sort_keys=True), replace=False):
        raise FileExistsError(f"manifest {number} of {folder} was written by another compaction; start again from it")


def at(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(get_text(spark, f"{folder}/{number}.json"))
