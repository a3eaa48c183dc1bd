"""A table that changes by small commits: segments, tombstones, flags, and a log that several writers append to.

Every commit is a file of the log, numbered from 1, and a folder of its own beside it:

* ``rows/``: the rows that it puts in;
* ``keys/``: the keys that it decides. All rows of these keys in earlier commits are gone, whether it puts in new ones (upsert) or not (delete);
* ``flags/``: keys with a new value of one boolean column, laid over their rows (a flip writes no row).

What is read at a commit is, for each key, the rows of the last commit that decides it, with the last flag after that. A commit writes in proportion to what
it changes; ``merge`` folds the commits up to one into a single one, once those after it have grown to a share of it.

Writers take no lock. A log file is put only where none stands yet: by a hard link on a local disk and a rename elsewhere (which must not replace
files, as HDFS's doesn't). The writer that comes second looks at the commits since its own reading: if one of them touches one of its keys, it stops with
Conflict, else it takes the next number. A commit that isn't in the log is not seen by any reader.

Defined cases: null keys are never matched and are refused; a key that is deleted and put in by one commit is put in; flags of unknown keys have no
effect; an empty commit is allowed; a table without commits can't be read.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(ValueError):
    """Another writer has changed one of the same keys."""


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    flag: str | None = None

    # --- the log --------------------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, number: int) -> str:
        return f"{self.root}/_log/{number:012d}"

    def head(self) -> int:
        """The number of the last commit, 0 if there is none."""
        path, fs = self._fs()
        folder = path(f"{self.root}/_log")
        return max((int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 0

    def _log(self, number: int) -> dict:
        """What is written in the log at a commit: its folder, and where a reader has to begin (after a merge)."""
        path, fs = self._fs()
        stream = fs.open(path(self._entry(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, number: int, entry: dict) -> bool:
        """Puts a log file where none stands; False if one does."""
        path, fs = self._fs()
        fs.mkdirs(path(f"{self.root}/_log"))
        temporary = path(f"{self.root}/_log/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        local = fs.getUri().getScheme() == "file"
        try:
            if local:
                os.link(temporary.toUri().getPath(), path(self._entry(number)).toUri().getPath())
                return True
            return fs.rename(temporary, path(self._entry(number)))
        except FileExistsError:
            return False
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    # --- reading --------------------------------------------------------------------------------------------------------------

    def _table(self, kind: str, numbers: list[int]) -> DataFrame:
        """The rows, keys or flags of some commits, with the commit's number."""
        key = self.schema[self.key]
        fields = {"rows": self.schema.fields, "keys": [key], "flags": [key, T.StructField("_flag", T.BooleanType())]}[kind]
        out = self.spark.createDataFrame([], T.StructType([*fields, T.StructField("_commit", T.LongType())]))
        for n in numbers:  # as many as commits since the last merge
            folder = self._log(n)["folder"]
            part = self.spark.read.schema(T.StructType(fields)).parquet(f"{self.root}/{folder}/{kind}")
            out = out.unionByName(part.withColumn("_commit", F.lit(n).cast("long")))
        return out

    def since(self, at: int) -> list[int]:
        """The commits that a reader of commit ``at`` has to look at."""
        return list(range(self._log(at)["begin"], at + 1)) if at else []

    def read(self, at: int | None = None) -> DataFrame:
        """The table as of a commit (the last one unless said otherwise)."""
        at = self.head() if at is None else at
        if not at:
            raise ValueError(f"no commit in {self.root}")
        numbers = self.since(at)
        decided = self._table("keys", numbers).groupBy(F.col(self.key).alias("_k")).agg(F.max("_commit").alias("_last"))
        rows = self._table("rows", numbers)
        rows = rows.join(decided, (F.col(self.key) == F.col("_k")) & (F.col("_commit") == F.col("_last"))).drop("_k", "_last")
        if self.flag is None:
            return rows.drop("_commit")
        flags = self._table("flags", numbers).groupBy(F.col(self.key).alias("_k")).agg(F.max(F.struct("_commit", "_flag")).alias("_f"))
        rows = rows.join(flags, (F.col(self.key) == F.col("_k")) & (F.col("_f._commit") > F.col("_commit")), "left")
        return rows.withColumn(self.flag, F.coalesce("_f._flag", self.flag)).drop("_commit", "_k", "_f")

    # --- writing --------------------------------------------------------------------------------------------------------------

    def commit(self, base: int, rows: DataFrame | None = None, delete: DataFrame | None = None, flags: DataFrame | None = None) -> int:
        """Appends one commit that was made from the table as of ``base``: rows put in (all earlier rows of their keys are replaced), keys of ``delete`` taken
        out, and ``flags`` (key, flag) laid over. Returns its number."""
        key = self.schema[self.key]
        nothing = lambda fields: self.spark.createDataFrame([], T.StructType(fields))
        rows = nothing(self.schema.fields) if rows is None else rows.select(*self.schema.names)
        flags = nothing([key, T.StructField("_flag", T.BooleanType())]) if flags is None else flags.select(self.key, F.col(self.flag).alias("_flag"))
        folder = f"commit-{uuid.uuid4().hex}"
        known = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a key is null")).cast(key.dataType)).otherwise(F.col(self.key)).alias(self.key)
        rows.withColumn(self.key, known).write.parquet(f"{self.root}/{folder}/rows")
        put = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}/rows").select(self.key)
        (put if delete is None else put.unionByName(delete.select(known))).distinct().write.parquet(f"{self.root}/{folder}/keys")
        flags.write.parquet(f"{self.root}/{folder}/flags")
        mine = self._touched([f"{self.root}/{folder}"])
        number, seen = base, base
        while True:
            head = self.head()
            others = [f"{self.root}/{e['folder']}" for e in map(self._log, range(seen + 1, head + 1)) if not e.get("merge")]
            if others and self._touched(others).join(mine, self.key, "left_semi").limit(1).count():
                raise Conflict(f"commits {seen + 1} to {head} change the same keys")
            seen, number = head, head + 1
            begin = self._log(head)["begin"] if head else 1
            if self._put(number, {"folder": folder, "begin": begin}):
                return number

    def _touched(self, folders: list[str]) -> DataFrame:
        key = T.StructType([self.schema[self.key]])
        return self.spark.read.schema(key).parquet(*(f"{f}/{kind}" for f in folders for kind in ("keys", "flags"))).distinct()

    def sizes(self, at: int) -> dict[int, int]:
        """Bytes of each commit that a reader of ``at`` looks at."""
        path, fs = self._fs()
        return {n: fs.getContentSummary(path(f"{self.root}/{self._log(n)['folder']}")).getLength() for n in self.since(at)}

    def merge(self, share: float = 0.5) -> int | None:
        """Folds all commits into one, if those after the first have grown to ``share`` of it. Returns its number, or None if there is nothing to do or another
        writer was faster; then the next call will do it. Old folders stay for those who read them."""
        head = self.head()
        sizes = self.sizes(head)
        if len(sizes) < 2 or sum(sizes.values()) - sizes[min(sizes)] < share * sizes[min(sizes)]:
            return None
        folder = f"merge-{uuid.uuid4().hex}"
        self.read(head).select(*self.schema.names).write.parquet(f"{self.root}/{folder}/rows")
        self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}/rows").select(self.key).distinct().write.parquet(f"{self.root}/{folder}/keys")
        self.spark.createDataFrame([], T.StructType([self.schema[self.key], T.StructField("_flag", T.BooleanType())])).write.parquet(f"{self.root}/{folder}/flags")
        return head + 1 if self._put(head + 1, {"folder": folder, "begin": head + 1, "merge": True}) else None
