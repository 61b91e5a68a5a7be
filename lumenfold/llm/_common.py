"""Shared plumbing: written intermediate tables, joins that survive hot keys, distributed ranks."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as a regular expression character class body.
SPACE = r"\x20\x09-\x0D"
#: A key with more than 1/HOT_SHARE of all rows counts as hot; so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where unset, and only in a local session) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        cache = sys.__dict__.setdefault("_lumenfold_cache", {})
        if "dir" not in cache:
            cache["dir"] = tempfile.mkdtemp(prefix="lumenfold-")
            atexit.register(shutil.rmtree, cache["dir"], ignore_errors=True)
        base = "file://" + cache["dir"]
    return base.rstrip("/")


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with one fact row per key, where `count` is the number of rows of the key.

    Keys holding over 1/HOT_SHARE of all rows (so at most HOT_SHARE of them) go by broadcast, the others by a
    shuffled join, in which then no key is large. Both inputs should be written tables: they are read twice. Rows with a
    null key, and keys without facts, are left out.
    """
    bound = max(1, total // HOT_SHARE)
    hot = facts.where(F.col(count) > bound)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(count) <= bound), key)
    return many.unionByName(few)


def parts_for(count: int, rows_per_part: int = 50_000) -> int:
    """How many parts to deal a key with so many rows into: a few hundred rows each while small, 50,000 when large."""
    return max(1, min(64, count // 500), -(-count // rows_per_part))


def ranked(rows: DataFrame, key: list[str], order: list, parts, name: str = "rank") -> DataFrame:
    """rows with a rank from 0 within key, dense and total, without gathering a key in one task.

    A key's rows are dealt into `parts` salted parts (a number, or a column that is constant in a key) by a hash of the
    order columns; ranks run through the parts in turn. rows should be a written table: it is read twice. One row a key
    and part passes the offset window.
    """
    parts = F.lit(parts) if isinstance(parts, int) else parts
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), parts.cast("long")).cast("int"))
    sums = salted.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_own", F.row_number().over(inner) - 1)
        .join(sums, [*key, "_salt"])
        .withColumn(name, F.col("_before") + F.col("_own"))
        .drop("_salt", "_own", "_before")
    )


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process (code sent by value has no lasting globals)."""
    return sys.__dict__.setdefault("_lumenfold_cache", {})


def chosen(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that decisions(id, text_hash) names, each once though it be repeated; one shuffle of docs."""
    keys = decisions.select(F.xxhash64(id_col).alias("_id"), F.col("text_hash").alias("_text"))
    rows = docs.withColumns({"_id": F.xxhash64(id_col), "_text": F.xxhash64(text_col)})
    return rows.join(keys, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).drop("_id", "_text")


def lean(batches, rows: int = 1_000):
    """Arrow batches in slices of some rows, so that few texts are Python objects at a time; freed memory goes back to the system."""
    for batch in batches:
        if batch.num_rows == 0:
            yield batch
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()
    give_back()


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
