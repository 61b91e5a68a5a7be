"""A corpus pipeline of operators in lumenfold.llm: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages read all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import chosen, written
from lumenfold.llm.exact_dedup import dedup_exact
from lumenfold.llm.mixing import mix, shuffled
from lumenfold.llm.near_dedup import near_duplicates
from lumenfold.llm.packing import default_tokenizer, pack_documents
from lumenfold.llm.toxicity import fit_toxicity, held_out, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go. It learns from the labels that are not held out."""
    docs = docs.select(COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score_toxicity(docs, fit_toxicity(docs, labels)).where("score < 0.5").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, by a digest index fed in batches of rising ids."""
    docs = docs.select(COLUMNS)
    decided = dedup_exact(docs)
    return chosen(docs, decided.where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    docs = docs.select(COLUMNS)
    return chosen(docs, near_duplicates(docs).where("representative"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix draws, dealt to the mix's shards and in their local order. A source's last draw holds
    just the words that its target still has room for, joined by single spaces (that one copy loses its line ends)."""
    rest = [c for c in COLUMNS if c != "doc_id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    rows = shuffled(mix(docs.select(COLUMNS), keep=tuple(rest)).where("taken > 0"), parts)
    whole = F.col("taken") - F.floor(F.col("taken") / F.col("size")) * F.col("size")  # words of a copy drawn in part
    torn = (whole > 0) & (F.col("copy") * F.col("size") > F.col("taken"))
    space = r"[\x20\x09-\x0D]+"
    words = F.split(F.regexp_replace("text", f"^{space}", ""), space)
    rows = rows.withColumn("text", F.when(torn, F.array_join(F.slice(words, F.lit(1), whole.cast("int")), " ")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(torn, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
