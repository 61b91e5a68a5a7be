"""Canonical exact fingerprints, in SQL functions only.

A text's canonical form is its NFKC normalisation, case-folded, with each run of white space one space and none at the
ends. The fingerprint is four xxhash64 values (256 bits) of it under different seeds. Texts whose fingerprints agree
are compared byte by byte (least and greatest canonical form of a bucket, which combines before the shuffle); where a
bucket holds different texts, a SHA-512 of the canonical form joins its members' fingerprints. Normalisation and folding are static methods of the
ICU library that Spark itself ships for collations, called through reflect().
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm._common import attach, written

#: Seeds of the four hash words.
SEEDS = (11, 23, 47, 91)


def canonical(text) -> F.Column:
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))  # folding can undo composition
    return F.trim(F.regexp_replace(again, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def wide_hash(canon) -> F.Column:
    """64 hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in SEEDS]))


def _range_of(key, cuts: list[int]) -> F.Column:
    """How many of the ascending cuts are greater than key; for null, all of them. Found by halving in an array literal."""
    edges = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    n = len(cuts)
    # first position (from 0) whose cut is greater than key
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(edges, at + step - 1) <= key), at + step).otherwise(at))
    return F.coalesce(F.when(key.isNotNull(), F.lit(n) - below), F.lit(n))


def bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 ids that cut the rows into ranges of about equal weight, from a percentile sketch."""
    if parts < 2:
        return []
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(id_col, cuts, min(20 * parts, max(20_000, 2 * parts))).alias("b")).first()["b"] or []
    return sorted(set(found))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: bool = False, range_chars: int | None = None) -> DataFrame:
    """One row per input row: id, n_chars (code points), fingerprint; null text counts as empty. Empty input: no rows.

    With edits, also what the fingerprint is worth under an edit: edited_sha256 and edited_fingerprint of the text
    whose last third of code points gave way to the beginning of the next document (descending ids, null ids last,
    the first after the last; rows of one id in the order of their texts' hash), and near_edited and near_next, the
    likeness (1 if the fingerprints are equal and so are the canonical bytes, else 0) to the edited text and to the
    next document. Edited texts are probes: they are compared with their document, not with each other.

    Texts are shuffled once, by id range. Hashes are found before, without texts; marks of ids whose hash occurs twice
    and the row each range borrows from the next one travel in the same shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = rows.select("id", F.length("text").alias("size"), canonical(F.col("text")).alias("c")).select("id", "size", wide_hash(F.col("c")).alias("h"))
    slim = written(slim, "hashes")
    n, chars = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # ranges of six million characters, and of up to a hundred million where there would be over a hundred thousand of them
    size = range_chars or min(100_000_000, max(6_000_000, chars // 100_000))
    cuts = bounds(slim.where("id IS NOT NULL"), "id", max(1, min(n, -(-chars // size))))
    # ranges count from the top: 0 holds the largest ids, the last one the null ids too
    place = _range_of(F.col("id"), cuts) if cuts else F.lit(0)
    twice = slim.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = written(twice, "twice")
    marks = attach(slim, twice, "h", "n", n).select("id").distinct()
    full = rows.select(place.alias("bucket"), "id", F.lit(0).alias("kind"), "text", F.lit(None).cast("boolean").alias("mark"))
    flags = marks.select(place.alias("bucket"), "id", F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))
    parts = [full, flags]
    if edits:
        # the first row of a range, borrowed by the one above it: its id, then its text
        first_ids = slim.groupBy(place.alias("bucket")).agg(F.max("id").alias("first_id"))  # one row a range
        chain = Window.orderBy("bucket")
        lent = first_ids.withColumn("to", F.coalesce(F.lag("bucket").over(chain), F.max("bucket").over(Window.partitionBy())))
        own = place.alias("bucket")
        firsts = rows.withColumn("bucket", own).join(F.broadcast(lent), "bucket").where(F.col("id").eqNullSafe(F.col("first_id")))
        pick = Window.partitionBy("bucket").orderBy(F.xxhash64("text"), "text")
        firsts = firsts.withColumn("turn", F.row_number().over(pick)).where("turn = 1")
        parts.append(firsts.select(F.col("to").alias("bucket"), "id", F.lit(1).alias("kind"), "text", F.lit(None).cast("boolean").alias("mark")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("lent", (F.col("kind") == 1).cast("int")).withColumn("order", F.xxhash64("text"))
    over = "OVER (PARTITION BY bucket ORDER BY lent, id DESC NULLS LAST, kind, order, text"
    every = every.withColumn("marked", F.expr(f"last(if(mark, struct(id), NULL), true) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    if edits:
        every = every.withColumn("next", F.expr(f"lead(text) IGNORE NULLS {over})"))
    every = every.where("kind = 0").withColumn("c", canonical(F.col("text")))
    twin = F.coalesce(F.col("marked.id").eqNullSafe(F.col("id")) & F.col("marked").isNotNull(), F.lit(False))
    cols = [F.col("id"), F.length("text").cast("long").alias("n_chars"), wide_hash(F.col("c")).alias("h"), F.when(twin, F.col("c")).alias("bytes"), F.sha2("c", 512).alias("digest")]
    if edits:
        every = every.withColumn("edited", F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 3) AS int)), substring(next, 1, cast(floor(length(text) / 3) AS int)))"))
        every = every.withColumn("ce", canonical(F.col("edited")))
        # only a text whose hash occurs twice can equal its neighbour
        same_next = F.when(twin, canonical(F.col("next")) == F.col("c")).otherwise(False)
        cols += [
            F.sha2("edited", 256).alias("edited_sha256"),
            wide_hash(F.col("ce")).alias("he"),
            F.sha2("ce", 512).alias("edited_digest"),
            (F.col("c") == F.col("ce")).cast("double").alias("near_edited"),
            same_next.cast("double").alias("near_next"),
        ]
    out = written(every.select(*cols), "fingerprints")
    ends = out.where("bytes IS NOT NULL").groupBy("h").agg(F.min("bytes").alias("a"), F.max("bytes").alias("z"))
    clash = ends.where("a <> z").select(F.col("h").alias("clash"))

    def settled(df: DataFrame, h: str, digest: str, name: str) -> DataFrame:
        df = df.join(clash, df[h] == F.col("clash"), "left")
        return df.withColumn(name, F.when(F.col("clash").isNotNull(), F.concat_ws("-", h, digest)).otherwise(F.col(h))).drop("clash")

    # no pair of texts with equal 256-bit hashes is expected: then nothing is joined
    if clash.isEmpty():
        out = out.withColumn("fingerprint", F.col("h"))
        out = out.withColumn("edited_fingerprint", F.col("he")) if edits else out
    else:
        out = settled(out, "h", "digest", "fingerprint")
        out = settled(out, "he", "edited_digest", "edited_fingerprint") if edits else out
    more = ["edited_sha256", "edited_fingerprint", "near_edited", "near_next"] if edits else []
    order = ["edited_sha256", "fingerprint", *more[1:]] if edits else ["fingerprint"]
    return out.select(F.col("id").alias(id_col), "n_chars", *order)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"), edits=True)
