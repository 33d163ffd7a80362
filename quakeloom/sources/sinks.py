"""What the plans write: Parquet with full doubles, CSV with twelve digits, JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import diagnostics, features, neighbors, targets


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def as_text(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles with `digits` significant digits, flags as true and false, nulls left."""
    show = {"double": lambda c: F.when(c.isNotNull(), F.format_string(f"%.{digits}g", c)), "boolean": lambda c: c.cast("string")}
    return df.select(*(show.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str, digits: int = 12) -> None:
    """Files with a header; nulls are empty cells."""
    as_text(df, digits).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_magnitude_diagnostics(catalog: DataFrame, path: str, width: float = 0.1) -> None:
    write_csv(diagnostics.magnitude_bins(catalog, width), f"{path}/magnitude_bins")
    write_csv(diagnostics.cutoff_counts(catalog), f"{path}/cutoff_counts")
    write_csv(diagnostics.yearly_cutoff_counts(catalog), f"{path}/yearly_cutoff_counts")


def write_link_diagnostics(linked: DataFrame, path: str, width: float = 0.1) -> None:
    write_csv(linked, f"{path}/links")
    write_csv(neighbors.eta_histogram(linked, width), f"{path}/log10_eta_histogram")


def write_training_set(rows: DataFrame, path: str) -> None:
    """Rows by year, and the names of features and targets, one per line."""
    write_parquet(rows.withColumn("year", F.year(F.timestamp_seconds("sort_time"))), f"{path}/rows", "year")
    for name, lines in (("features", features.names()), ("targets", targets.names())):
        _names(rows.sparkSession, lines).write.mode("overwrite").text(f"{path}/{name}")


def _names(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Names from a manifest, in order; a short list."""
    return [r.value for r in spark.read.text(path).collect() if r.value.strip()]
