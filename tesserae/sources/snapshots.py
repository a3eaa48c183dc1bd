"""Atomic snapshots on plain Parquet: write a new folder, then swap a pointer. One writer; readers always see a whole snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(root: str, **tables: DataFrame) -> str:
    """Write all tables under a new name and point CURRENT at it by a rename, which is what makes it visible."""
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    for t, df in tables.items():
        df.write.parquet(f"{root}/{name}/{t}")
    path, fs = _fs(spark, root)
    fs.mkdirs(path(f"{root}/_pointers"))
    number = max([int(x.getPath().getName()) for x in fs.listStatus(path(f"{root}/_pointers"))] or [0]) + 1
    temporary = path(f"{root}/_{name}")
    out = fs.create(temporary)
    out.write(bytearray(name.encode()))
    out.close()
    if not fs.rename(temporary, path(f"{root}/_pointers/{number:010d}")):
        raise OSError("another writer was faster")
    return name


def current(spark: SparkSession, root: str) -> str | None:
    path, fs = _fs(spark, root)
    folder = path(f"{root}/_pointers")
    if not fs.exists(folder):
        return None
    last = max(x.getPath().getName() for x in fs.listStatus(folder))
    return spark.read.text(f"{root}/_pointers/{last}").first()[0]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)}/{table}")
