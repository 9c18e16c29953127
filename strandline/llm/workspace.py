"""Tables in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a local
session where that is unset (tests, a laptop) gets a temporary one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from strandline.sources import files

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: they may run where
    it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="strandline-code-"), "strandline.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; only a local session may go without a setting."""
    return files.shared_root(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, *uris: str) -> None:
    for uri in uris:
        fs, path = _fs(spark, uri)
        fs.delete(path, True)


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _fs(spark, uri)
    return fs.exists(path)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob names anything."""
    fs, path = _fs(spark, pattern)
    return bool(fs.globStatus(path))


def names(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob names."""
    fs, path = _fs(spark, pattern)
    return [str(f.getPath().toString()) for f in fs.globStatus(path) or []]


def make(spark: SparkSession, uri: str) -> None:
    """An empty folder."""
    fs, path = _fs(spark, uri)
    fs.mkdirs(path)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; False if the target is there already."""
    fs, src = _fs(spark, source)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, jvm.org.apache.hadoop.fs.Path(target), none)
    except Exception:
        if fs.exists(src) and exists(spark, target):
            return False
        raise
    return True


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


class Table:
    """A DataFrame written to the shared folder: lineage ends here, and a lost
    executor costs only the tasks that it ran."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
