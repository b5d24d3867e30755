"""Shared plumbing: scratch tables in the shared folder and byte helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session of one machine (tests) gets a local one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and is read column by column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark._jvm
        for name in df.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if "/scratch/" in path.toString():
                fs.delete(path, True)
            break


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of the shared folder, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of finished phases now, not when memory runs
    short, and give back what the driver no longer uses."""
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Give back to the machine what a worker or the driver no longer uses: workers are kept between
    stages, and an executor's share must hold those of all of them."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if give_back:
        give_back(0)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that what a worker makes of one stays small."""
    trim()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        b = None
    trim()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Send workers batches of at most ``rows`` rows while tables of whole texts are written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def utf8_size(text: str | Column) -> Column:
    """Bytes of the text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def word_count(text: str | Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def content_hash(df: DataFrame, seed: int = 7) -> Column:
    """A hash of whole rows, to break ties between equal keys in the same way on each run."""
    simple = [F.col(f"`{c}`") if not kind.startswith("map") else F.map_entries(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(F.lit(seed), *simple)
