"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cached entries of one Python worker before it starts anew (about 150 bytes each).
CACHE_ENTRIES = 300_000
#: Rows of one Arrow batch; texts are long, and a batch is held several times on its way.
BATCH_ROWS = 1_000


class Memo(dict):
    """A dict that computes what it lacks. ``trim()`` between documents bounds its memory."""

    def __init__(self, compute: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> bool:
        if len(self) > self.limit:
            self.clear()
            return True
        return False


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; ``bytes.lower`` changes no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches of whole texts small, whatever rows the session's default puts into one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, *more: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns that an operator reads, whatever else the table holds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_parts(docs: DataFrame, per_partition: int, part_bytes: int) -> int:
    """Into how many parts to deal what comes of the texts: ``per_partition`` for each shuffle partition, or more, so that a
    part stands for ``part_bytes`` of text whatever the session's number of partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, per_partition * shuffle_partitions(docs.sparkSession), -(-total // part_bytes))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named the system's temporary folder serves, but only if all runs on this machine. What lies in the folder
    is needed until the results are read, so it's left to the cluster's clean-up of its checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quaverline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, key: Column, most: int) -> DataFrame:
    """``df``, or ``most`` of its rows: those with the least hashes of ``key``, and so the same on every run.

    Only hashes are sorted, ``most`` and one of each task. Of rows that tie at the edge, such as repeated ones, any fill up.
    """
    h = F.xxhash64(key)
    least = df.select(h.alias("h")).orderBy("h").limit(most + 1)
    n, edge = least.agg(F.count("*"), F.max("h")).first()
    if n <= most:
        return df
    below = least.filter(F.col("h") < edge).count()
    chosen = df.filter(h < edge)
    return chosen.unionAll(df.filter(h == edge).limit(most - below)) if below < most else chosen


def joined_back(rows: DataFrame, groups: DataFrame, key: str, size: str, most_hot: int = 1_000, least: int = 100) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each ``key`` and its number of rows in ``size``.

    A group may hold a third of all rows. Those with more than a ``most_hot``-th of them (and more than ``least``) are less than
    ``most_hot``: they are broadcast and their rows stay where they are. The others meet in a shuffle that no key dominates.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > max(least, total // most_hot))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= max(least, total // most_hot)), key)
    return near.unionByName(far)


def binary(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
