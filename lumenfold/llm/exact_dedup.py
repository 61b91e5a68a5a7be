"""Exact duplicates through a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, anti-joined to the index
bucket by bucket, and the digests the index lacks are appended; decisions are read back from the index. Equality: texts identical after each run of ASCII
white space became one space; null counts as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import SPACE, attach, written


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


class DigestIndex:
    """A table (digest, keep_id, keep_row, n; batch), partitioned by batch, bucketed and sorted by digest: one row per
    distinct text seen so far, in the batch that brought it first.

    `buckets` is fixed when the table is made; take about one per 2 million expected digests.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 8):
        self.spark, self.table, self.buckets = spark, table, buckets

    def create(self) -> DigestIndex:
        """The empty table, unless it exists."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, n BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        return self

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, rows: DataFrame, batch: str) -> None:
        """rows(doc_id, digest, row): the batch is reduced to a row per digest, those the index has from other batches go by a
        sort-merge anti-join bucket by bucket, the rest becomes the batch's partition. The same batch again writes the same."""
        self.create()
        best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "row"))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        groups = groups.select("digest", F.col("best.id").cast("long").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")
        known = self.entries().where(F.col("batch") != batch).select("digest")
        new = written(groups.join(known.hint("merge"), "digest", "left_anti"), "new-digests")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = :batch) SELECT digest, keep_id, keep_row, n FROM {{new}}",
            args={"batch": batch}, new=new.repartition(self.buckets, "digest"),
        )

    def absorb(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Decide every row of docs against the index and the batch itself, and append what is new.

        Returns one row per input row: the id, keep_id (id of the row that stays: from the index if the text was
        there, else the smallest id of the batch, null ids last), group_size (rows of the batch with this text),
        kept, text_sha256, text_hash (xxhash64 of the text as it is, to find the row again). Repeated rows with one id:
        exactly one of them is kept. Empty input: no rows. Other columns are ignored, whatever their names.
        `batch` names the batch: a batch given again, say after a lost driver, is decided as the first time.
        """
        batch = batch or uuid.uuid4().hex
        rows = written(digests(docs, id_col, text_col), "digests")
        self.append_new(rows, batch)
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        return decided(rows, self.entries().join(sizes, "digest"), batch, id_col)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    return docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.xxhash64(text_col).alias("text_hash")).withColumn("row", F.monotonically_increasing_id())


def decided(rows: DataFrame, entries: DataFrame, batch: str | None, id_col: str) -> DataFrame:
    """rows with what the index says of their digest; a row stays if the index has it as its digest's first, from this
    batch (from any, where batch is None: rows are then numbered through)."""
    own = F.lit(True) if batch is None else F.col("batch") == batch
    facts = written(entries.select("digest", "keep_id", F.when(own, F.col("keep_row")).alias("keep_row"), "group_size"), "decided")
    out = attach(rows, facts, "digest", "group_size", rows.count())
    return out.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """All of docs through an index of its own, as `batches` batches of rising ids, so that the smallest id of equal texts
    comes first; the columns of absorb(), group_size over all batches. Null ids are in the last batch.

    The index is dropped once its decisions are written. Empty input: no rows.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    n = rows.count()
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    turn = sum((F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in dict.fromkeys(cuts)), F.lit(0))
    index = DigestIndex(docs.sparkSession, f"lumenfold_digests_{uuid.uuid4().hex}", max(8, n // 2_000_000))
    try:
        for k in range(len(dict.fromkeys(cuts)) + 1):
            index.append_new(rows.where(turn == k), f"{k:06d}")
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        return decided(rows, index.entries().join(sizes, "digest"), None, id_col)
    finally:
        index.drop()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two batches, against an index that starts empty."""
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


ORACLE = {
    "op3_exact_dedup": r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
    """
}
