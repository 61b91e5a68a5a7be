"""Event tables of the test data in the engine's canonical form, and spectra derived from their classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.arrays import as_doubles, scaled
from lumenfold.functions.ranks import array_quantiles
from lumenfold.operators.unmix import Panel

WIDTH = 64


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x): each vector is an event, its 64 elements the detectors, its label the control sample."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", as_doubles("embedding").alias("x"))


def lineitem(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_spectra(df: DataFrame, key: str = "label", array_col: str = "x", width: int = WIDTH, how=F.avg) -> DataFrame:
    """(key, spectrum): one aggregate a detector, in one pass without exploding the events."""
    return df.groupBy(key).agg(F.array(*[how(F.get(array_col, F.lit(i))) for i in range(width)]).alias("spectrum"))


def class_medians(df: DataFrame, key: str = "label", array_col: str = "x", width: int = WIDTH, q: float = 0.5) -> DataFrame:
    """(key, spectrum): the exact median (or another quantile) of every detector, by bits: see array_quantiles(). Runs at once.
    Elements without values are NaN; null keys are left out."""
    keys, got = array_quantiles(df, key, array_col, width, [q])
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(k, v[0].tolist()) for k, v in zip(keys, got, strict=True)], f"{key} {kind}, spectrum array<double>")


def all_classes(ev: DataFrame) -> Panel:
    return Panel.collect(class_spectra(ev), "label", "spectrum")


def dyes_and_background(ev: DataFrame) -> tuple[Panel, Panel]:
    """Classes 1 to 9 as dyes; five parts of class 0, each scaled to a largest absolute value of 1, as background."""
    dyes = Panel.collect(class_spectra(ev.where("label > 0")), "label", "spectrum")
    parts = class_spectra(ev.where("label = 0").withColumn("j", F.col("vec_id") % 5), "j")
    parts = parts.withColumn("spectrum", scaled(F.col("spectrum"), F.array_max(F.transform("spectrum", F.abs))))
    return dyes, Panel.collect(parts, "j", "spectrum")
