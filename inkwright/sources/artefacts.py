"""Artefacts (compiled formulas, drawings) under the hash of what they were made from.

The store is a folder of Parquet files, ``put=<name>/bucket=<prefix of the key>``. Each put owns its
folder, so writers never touch each other's files, and a put that runs again replaces its own. Which
artefact of a key counts is settled by the reader, the same way for all: the one put first.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z0-9-]+")


class Artefacts:
    """A store of artefacts: ``payload`` columns by key, a string of lowercase hexadecimal digits.

    ``digits`` of a key name its bucket; two give 256. A store keeps the number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, payload: str = "value binary", digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self.payload = [f.name for f in spark.createDataFrame([], payload).schema]
        self._schema = f"key string, stored_at timestamp, {payload}, put string, bucket string"

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def puts(self) -> list[str]:
        """Names of the puts in the store, ascending. Driver-side: one a put, which compact() makes few."""
        fs, path = self._folder()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.removeprefix("put=") for n in found if n.startswith("put="))

    def _rows(self, puts: list[str]) -> DataFrame:
        if not puts:
            return self.spark.createDataFrame([], self._schema)
        folders = [f"{self.path}/put={p}" for p in puts]
        return self.spark.read.schema(self._schema).option("basePath", self.path).parquet(*folders)

    def _bucket(self, key: str | Column = "key") -> Column:
        return F.left(F.col(key) if isinstance(key, str) else key, F.lit(self.digits))

    def _first(self, rows: DataFrame) -> DataFrame:
        """Of each key the artefact put first; puts of one instant go by name."""
        names = ["stored_at", "put", *self.payload]
        best = rows.groupBy("bucket", "key").agg(F.min(F.struct("stored_at", "put")).alias("f"), F.min_by(F.struct(*names), F.struct("stored_at", "put")).alias("a"))
        return best.select("key", "a.*", "bucket")

    def read(self) -> DataFrame:
        """key, stored_at, put, the payload and bucket: one row a key."""
        return self._first(self._rows(self.puts()))

    def lookup(self, df: DataFrame, key: str = "key") -> DataFrame:
        """df with the payload of each row's key, null without one, and hit.

        Only artefacts that are asked for are exchanged, and only their buckets are read where few
        are asked for. A null key hits nothing. Repeated rows stay; df must have none of the added columns.
        """
        wanted = df.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("bucket", self._bucket())
        found = self._first(self._rows(self.puts()).join(wanted, ["bucket", "key"], "left_semi"))
        side = found.select(F.col("key").alias("__key"), *self.payload, F.lit(True).alias("hit"))
        out = df.join(side, F.col(key) == F.col("__key"), "left").drop("__key")
        return out.withColumn("hit", F.coalesce("hit", F.lit(False)))

    def put(self, rows: DataFrame, name: str, at: datetime | None = None) -> None:
        """Store rows (key and the payload) whose key the store does not hold yet, as the put ``name``.

        Rows with a null or malformed key or without any payload are not artefacts and are left out:
        failures aren't stored. Of rows with one key the least payload is taken, so that a rerun
        chooses the same. Run again after a failure, or twice, a put leaves what it leaves run once.
        Of two at one time, both keep their files, and readers take the earlier one's artefacts.
        """
        if not NAME.fullmatch(name):
            raise ValueError(f"a put is named by letters, digits and hyphens, not {name!r}")
        whole = F.col("key").rlike(f"^[0-9a-f]{{{self.digits},}}$") & F.coalesce(*[F.col(c).cast("string") for c in self.payload]).isNotNull()
        one = rows.filter(whole).groupBy("key").agg(F.min(F.struct(*self.payload)).alias("a")).select("key", "a.*")
        # its own earlier files don't count: they are written anew
        held = self._rows([p for p in self.puts() if p != name]).select("bucket", "key")
        new = one.withColumn("bucket", self._bucket()).join(held, ["bucket", "key"], "left_anti")
        self._write(new.withColumn("stored_at", F.lit(at or datetime.now(timezone.utc)).cast("timestamp")), name)

    def _write(self, rows: DataFrame, name: str) -> None:
        out = rows.select("key", "stored_at", *self.payload, F.lit(name).alias("put"), "bucket")
        # rows of a bucket meet in one task, which adaptive execution splits where they are many
        ordered = out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        ordered.option("compression", "zstd").partitionBy("put", "bucket").parquet(self.path)

    def compact(self, name: str) -> int:
        """Write the artefacts of all puts there are now as one put, then delete those; how many.

        Puts that begin meanwhile are left alone. Interrupted, artefacts stand twice at worst, with
        the same time, and count once. Queries that were planned before must be planned again.
        """
        old = [p for p in self.puts() if p != name]
        if not NAME.fullmatch(name) or name in self.puts():
            raise ValueError(f"a new name must be given, not {name!r}")
        if old:
            self._write(self._first(self._rows(old)), name)
        for p in old:
            fs, path = self._folder(f"put={p}")
            fs.delete(path, True)
        return len(old)
