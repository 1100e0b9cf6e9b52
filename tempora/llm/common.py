"""Shared pieces: durable intermediate tables, byte-level word rules, fixed hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table: lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: bytes.translate table: lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, blanks the rest.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

#: Java/RE2 pattern of a white-space separated word.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a folder of our own if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tempora-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempora_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by durable() that no later plan reads."""
    path = getattr(df, "_tempora_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers outlive their tasks and would sit on it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes."""
    return F.col(column).cast("binary")


def sample_labels(labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """At most `rows` labelled documents (doc_id, label, order), chosen by hash of doc_id among those `keep` admits.

    Rows with a null id or label are not labels; of repeated ids the smallest label counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(keep(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.col(label)).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(rows)
    )


def id_crc(doc_id):
    """crc32 of an id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
