"""Small texts in a shared store: written beside their place and renamed there, so that no reader meets half of one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def store_of(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a text and rename it to its place in one step: in place of the old one, which readers see until then, or,
    without `replace`, only where there is none. Returns whether it is there now."""
    jvm = spark.sparkContext._jvm
    at, beside = path_of(spark, path), path_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    store = store_of(spark, path)
    local = store.getScheme() == "file"
    if local:
        store = store.getRawFileSystem()  # no checksum beside the text, which would be replaced in a second step
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace and local:
        return store.rename(beside, at)  # a local store replaces in one step here, a file context would delete first
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(beside, at, how)
        return True
    except Exception as e:  # py4j's; only a place that is taken means that another was first
        if not replace and "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
            store.delete(beside, False)
            return False
        raise


def text_at(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    stream = store_of(spark, path).open(path_of(spark, path))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none where it is not there."""
    store, at = store_of(spark, path), path_of(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []
