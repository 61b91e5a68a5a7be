"""URL filter: rules first, then a character language-model ratio, in SQL functions only.

Two variable-order Markov models of URL characters, one of accepted and one of rejected URLs, are counted over all
URLs that a rule decides. Probabilities interpolate orders 2, 1 and 0 by Witten-Bell smoothing. A URL's score is the
difference of its log-likelihoods per character; the threshold is the one that separates accepted from rejected URLs
best (balanced error over all of them). The alphabet has 35 symbols, so the models are one array of 35^3 numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm._common import written

# The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Symbols: start, end, any other, then characters; all digits count as 0.
ALPHABET = "\x02\x03\x04abcdefghijklmnopqrstuvwxyz0./-_%"
V = len(ALPHABET)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores fall into bins of this width for the threshold.
BIN = 0.01


def parts(url) -> tuple[F.Column, F.Column]:
    """(host, path): both empty for null or where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host, path, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def codes(url) -> F.Column:
    """Symbol numbers of what follows the scheme, between two starts and an end."""
    rest = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), r"(?s)^.*?://", "")
    plain = F.regexp_replace(F.regexp_replace(rest, "[0-9]", "0"), r"(?s)[^a-z0./_%-]", "\x04")
    marked = F.concat(F.lit("\x02\x02"), plain, F.lit("\x03"))
    return F.transform(F.split(marked, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def ratio_model(labelled: DataFrame) -> str:
    """labelled(codes, accepted) -> JSON array of V^3 log-probability differences, indexed by the three symbols."""
    grams = F.expr("transform(sequence(2, size(codes) - 1), i -> codes[i - 2] * %d + codes[i - 1] * %d + codes[i])" % (V * V, V))
    n3 = labelled.where("size(codes) > 2").select("accepted", F.explode(grams).alias("g")).groupBy("accepted", "g").agg(F.count(F.lit(1)).alias("n"))
    n3 = written(n3, "grams").withColumns({"a": F.floor(F.col("g") / (V * V)).cast("int"), "b": F.pmod(F.floor(F.col("g") / V), F.lit(V)).cast("int"), "c": F.pmod("g", F.lit(V)).cast("int")})
    both = [n3.where("accepted"), n3.where("NOT accepted")]
    spark = labelled.sparkSession
    every = spark.range(V**3).select(F.col("id"), F.floor(F.col("id") / (V * V)).cast("int").alias("a"), F.pmod(F.floor(F.col("id") / V), F.lit(V)).cast("int").alias("b"), F.pmod("id", F.lit(V)).cast("int").alias("c"))
    diff = F.lit(0.0)
    for k, n in enumerate(both):
        uni = n.groupBy("c").agg(F.sum("n").alias("x0"))
        whole = Window.partitionBy()  # V symbols, and V^3 numbers below
        uni = uni.withColumns({"t0": F.sum("x0").over(whole), "d0": F.count(F.lit(1)).over(whole)})
        bi = n.groupBy("b", "c").agg(F.sum("n").alias("x1"))
        ctx1 = bi.groupBy("b").agg(F.sum("x1").alias("t1"), F.count(F.lit(1)).alias("d1"))
        ctx2 = n.groupBy("a", "b").agg(F.sum("n").alias("t2"), F.count(F.lit(1)).alias("d2"))
        every = every.join(uni, "c", "left").join(bi, ["b", "c"], "left").join(n.select("a", "b", "c", F.col("n").alias("x2")), ["a", "b", "c"], "left")
        every = every.join(ctx1, "b", "left").join(ctx2, ["a", "b"], "left").withColumns({"t0": F.max("t0").over(whole), "d0": F.max("d0").over(whole)})
        p = F.lit(1.0 / V)
        for o in (0, 1, 2):  # with nothing counted in a context, the shorter one decides
            x, t, d = (F.coalesce(F.col(f"{name}{o}"), F.lit(0)) for name in "xtd")
            p = F.when(t + d > 0, (x + d * p) / (t + d)).otherwise(p)
        name = f"lp{k}"
        every = every.withColumn(name, F.log(p)).drop(*[f"{m}{o}" for m in "xtd" for o in (0, 1, 2)])
    diff = F.round(F.col("lp0") - F.col("lp1"), 6)
    # V^3 numbers, whatever the corpus
    return every.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", diff.alias("d")))), lambda s: s["d"])).alias("m")).first()["m"]


def log_ratio(model: str, codes_col: str = "codes") -> F.Column:
    """Length-normalised difference of log-likelihoods, positive where the accepted model fits better."""
    table = F.from_json(F.lit(model), "array<double>")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(st, c):
        return F.struct((st["s"] + F.get(table, (st["a"] * V + st["b"]) * V + c)).alias("s"), st["b"].alias("a"), c.alias("b"))

    tail = F.slice(codes_col, F.lit(3), F.size(codes_col))
    return F.aggregate(tail, start, step, lambda st: st["s"]) / F.greatest(F.size(codes_col) - 2, F.lit(1))


def best_threshold(scored: DataFrame) -> float | None:
    """scored(score, accepted): the bin edge with the least balanced error, nearest zero among equals; None without both classes."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    bins = bins.withColumns({"lost": F.coalesce(F.sum("good").over(below), F.lit(0)), "stopped": F.coalesce(F.sum("bad").over(below), F.lit(0)), "n_good": F.sum("good").over(all_rows), "n_bad": F.sum("bad").over(all_rows)})
    bins = bins.where("n_good > 0 AND n_bad > 0")  # without both verdicts no bin is left
    error = F.try_divide(F.col("lost"), F.col("n_good")) + 1 - F.try_divide(F.col("stopped"), F.col("n_bad"))
    # all edges above the bin before, up to this one, part the scores alike
    nearest = F.least(F.col("bin"), F.lit(0))
    edge = F.greatest(F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, nearest), nearest)
    bins = bins.withColumns({"edge": edge, "error": error})
    row = bins.orderBy("error", F.abs("edge")).select("edge").first()
    return row["edge"] * BIN if row else None


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict, score, threshold.

    The models are counted on four fifths of the URLs that a rule decides (by a hash, so equal URLs stay together), the
    threshold is calibrated on the last fifth; on all of them, if that lacks a verdict (few URLs, or one verdict only). Null or odd URLs have empty host and
    path, fit no rule and are scored as what they are. Without URLs of both verdicts the score decides at 0, and equal models
    give 0: allow. Empty input: no rows.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), codes(F.col(url_col)).alias("codes"))
    rows = rows.withColumns({"ruled": rule_of(F.col("host"), F.col("path"), rules), "held": F.pmod(F.xxhash64("codes"), F.lit(5)) == 0})
    rows = written(rows, "urls")
    labelled = rows.where("ruled IS NOT NULL").select("codes", "held", (F.col("ruled.verdict") == "allow").alias("accepted"))
    rows = rows.withColumn("score", log_ratio(ratio_model(labelled.where("NOT held"))))
    rows = written(rows.drop("codes"), "scored")
    known = rows.where("ruled IS NOT NULL").select("score", "held", (F.col("ruled.verdict") == "allow").alias("accepted"))
    threshold = next((t for t in (best_threshold(known.where("held")), best_threshold(known)) if t is not None), 0.0)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.select(F.col("page_id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
