"""Mixing sources to target weights by a multivariate hypergeometric splitting tree, in DataFrame operations only.

1. Targets. Sources get words in proportion to weights, none beyond `max_epochs` times its own words; what a full
   source cannot take is reshared by weight (water filling, in closed form by prefix sums).
2. Blocks. A source's documents fall by hash into `blocks` blocks. Whole passes over a source draw every block once
   a pass; the rest of the target is a run of permuted blocks whose last one is drawn in part, cut at the word.
3. Splitting tree. The drawn blocks of every source are quotas. A node of the tree gives its left half of output
   shards a multivariate hypergeometric sample of its quotas (exact: quota counts among the first n_left of a random
   permutation of the node's draws), and so on down to single shards.
4. Drawing. Each shard's quotas become disjoint runs of the source's permuted draws, so shards never share a draw;
   inside a shard documents go in hash order.

Everything derives from hashes of the seed, so reruns agree. Tables per source and block (not per document) pass
through single tasks: sources * blocks * max_epochs rows at most, independent of the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm._common import SPACE, written

BEFORE = (Window.unboundedPreceding, -1)


def word_count(text) -> F.Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> and target: sources by code point (null last) weigh as `weights`, repeating."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("fills_at", F.col("cap") / F.col("w"))
    every, up_to = Window.partitionBy(), Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(*BEFORE)
    s = (
        s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
    )
    # the level of the first source that does not fill; where all fill, no bound
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "source", "level"))).over(every)
    at = F.coalesce(level["level"], F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("cap"), F.col("w") * at)).select("source", "source_size", "target")


def _split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas(source, q) of all draws -> (shard, source, q): the tree, one window per level."""
    level = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "source", "q")
    depth = (shards - 1).bit_length()
    for k in range(depth):
        node = Window.partitionBy("lo", "hi")
        draws = level.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("q").cast("int"))))
        draws = draws.withColumn("mid", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int"))
        share = (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        draws = draws.withColumn("n_left", F.round(F.count(F.lit(1)).over(node) * share))
        turn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed + k), "lo", "source", "i"), F.col("source").asc_nulls_last(), "i"))
        left = (F.col("hi") - F.col("lo") == 1) | (turn <= F.col("n_left"))
        draws = draws.select("lo", "hi", "mid", "source", left.alias("left"))
        single = F.col("hi") - F.col("lo") == 1
        level = draws.select(
            F.when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"),
            F.when(F.col("left") & ~single, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
            "source",
        ).groupBy("lo", "hi", "source").agg(F.count(F.lit(1)).alias("q"))
    return level.select(F.col("lo").alias("shard"), "source", "q")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, blocks: int = 64, shards: int = 16, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted), shards
    (the shard of each drawn copy; empty when nothing is taken) and shuffle_key.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Repeated rows: each is a row of its
    own. Empty input: no rows. `keep` names columns of docs to carry; all others are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "hash")).drop("hash")
    n = docs.count()
    subs = max(1, n // (blocks * 20_000))
    rows = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("sub", F.pmod(F.shiftright("key", 20), F.lit(subs)).cast("int"))
    rows = written(rows, "mix-rows")
    sums = written(rows.groupBy("source", "block", "sub").agg(F.sum("size").alias("words")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    size = F.col("source_size")
    plan = plan.withColumn("passes", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("passes") * size).cast("long"))
    plan = written(plan, "mix-plan")

    def with_plan(df: DataFrame, facts: DataFrame, *on: str) -> DataFrame:
        f = facts.withColumnRenamed("source", "_source")
        cond = df["source"].eqNullSafe(f["_source"])
        for c in on:
            f = f.withColumnRenamed(c, f"_on_{c}")
            cond = cond & (F.col(c) == F.col(f"_on_{c}"))
        return df.join(f, cond, "left").drop("_source", *[f"_on_{c}" for c in on])

    # permuted blocks: how many words each gives beyond whole passes
    per_block = sums.groupBy("source", "block").agg(F.sum("words").alias("words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 101), "source", "block"), "block")
    per_block = with_plan(per_block, plan).withColumn("place", F.row_number().over(order) - 1)
    gone = F.coalesce(F.sum("words").over(order.rowsBetween(*BEFORE)), F.lit(0))
    per_block = per_block.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - gone)))
    # draws of a block: one a pass, one more if part of it is taken
    per_block = per_block.withColumn("drawn", F.when(F.col("words") > 0, F.col("passes") + (F.col("part") > 0).cast("int")).otherwise(0))
    per_block = written(per_block.select("source", "block", "words", "part", "place", "drawn"), "mix-blocks")
    # the tree over quotas, then disjoint runs of permuted draws
    quotas = per_block.groupBy("source").agg(F.sum("drawn").alias("q")).where("q > 0")
    leaves = _split(quotas, shards, seed)
    run = Window.partitionBy("source").orderBy("shard").rowsBetween(*BEFORE)
    leaves = leaves.withColumn("first", F.coalesce(F.sum("q").over(run), F.lit(0))).select("shard", "source", F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("q") - 1).cast("int"))).alias("turn"))
    draws = per_block.where("drawn > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)).alias("pass"))
    perm = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 202), "source", "block", "pass"), "block", "pass")
    draws = draws.withColumn("turn", F.row_number().over(perm) - 1)
    draws = with_plan(draws, leaves, "turn").groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at"))
    facts = with_plan(with_plan(per_block, plan), draws, "block")
    facts = written(facts.select("source", "block", "words", "part", "source_size", "target", "passes", F.coalesce(F.col("at.shard"), F.array().cast("array<int>")).alias("at")), "mix-facts")
    # the cut inside the one block of a source that is drawn in part: first its sub-blocks, then documents
    cut = facts.where("part > 0 and part < words").select("source", "block", "part")
    per_sub = with_plan(cut, sums, "block")
    inside = Window.partitionBy("source", "block").orderBy("sub").rowsBetween(*BEFORE)
    per_sub = per_sub.withColumn("gone", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    per_sub = per_sub.withColumn("sub_part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("part") - F.col("gone"))))
    per_sub = written(per_sub.select("source", "block", "sub", F.col("words").alias("sub_words"), "sub_part"), "mix-subs")

    out = with_plan(rows, facts, "block")
    out = with_plan(out, per_sub, "block", "sub")
    part = F.when(F.col("part") <= 0, F.lit(0)).when(F.col("part") >= F.col("words"), F.col("size"))
    part = part.when(F.col("sub_part") <= 0, F.lit(0)).when(F.col("sub_part") >= F.col("sub_words"), F.col("size"))
    out = out.withColumn("more", part.cast("long"))
    settled = out.where(F.col("more").isNotNull())
    local = Window.partitionBy("source", "block", "sub").orderBy("key", "doc_id", "_row").rowsBetween(*BEFORE)
    torn = out.where(F.col("more").isNull()).withColumn("_gone", F.coalesce(F.sum("size").over(local), F.lit(0)))
    torn = torn.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("sub_part") - F.col("_gone"))).cast("long")).drop("_gone")
    out = settled.unionByName(torn)
    taken = F.col("passes") * F.col("size") + F.col("more")
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("more") > 0).cast("int")).otherwise(0)
    return out.select(
        F.col("doc_id").alias(id_col),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        taken.cast("long").alias("taken"),
        F.slice("at", F.lit(1), copies).alias("shards"),
        F.xxhash64(F.lit(seed + 303), "doc_id").alias("shuffle_key"),
    )


def shuffled(mixed: DataFrame, parts_per_shard: int = 1) -> DataFrame:
    """One row per drawn copy (`copy` counts from 1, `shard` is where it goes), dealt to its shard's partitions and in hash
    order there."""
    rows = mixed.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards").withColumn("copy", F.col("copy") + 1)
    rows = rows.withColumn("shuffle_key", F.xxhash64("shuffle_key", "copy")).withColumn("_part", F.pmod("shuffle_key", F.lit(parts_per_shard)))
    return rows.repartition("shard", "_part").sortWithinPartitions("shard", "shuffle_key").drop("_part")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
