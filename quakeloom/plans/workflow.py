"""The whole way from a raw catalog to clusters and a training set."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quakeloom.operators import clusters, contract, features, mixture, neighbors, targets
from quakeloom.params import DEFAULT, Params
from quakeloom.session import cut
from quakeloom.sources import raw, sinks


def cluster(catalog: DataFrame, p: Params = DEFAULT, fit_eta0: bool = False) -> DataFrame:
    """Clustered events of magnitude m_c or more; the threshold is given, or fitted to this catalog."""
    linked = cut(neighbors.with_parents(catalog, p))
    if fit_eta0:
        threshold = mixture.fit(linked).where("k = 2").first().log10_eta0
        p = replace(p, log10_eta0=threshold)
        linked = linked.withColumn("is_strong", linked["log10_eta"].isNotNull() & (linked["log10_eta"] < threshold))
    return clusters.assign(linked)


def training_set(clustered: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Features and targets of a clustered catalog, which is made once."""
    once = cut(clustered)
    return features.build(once, p).join(targets.build(once, p.horizon_hours), "event_id")


def run(spark: SparkSession, path: str, out: str, p: Params = DEFAULT, cutoffs: tuple[float, ...] = ()) -> None:
    """Reads raw files, and writes diagnostics, links for each cutoff, clusters and the training set.

    Raises if the clusters break their contract.
    """
    catalog = cut(raw.catalog(raw.read_csv(spark, path)))
    sinks.write_magnitude_diagnostics(catalog, f"{out}/magnitudes")
    by_cutoff = cut(neighbors.with_parents_by_cutoff(catalog, list(cutoffs), p)) if cutoffs else None
    for m_c in cutoffs:
        sinks.write_link_diagnostics(by_cutoff.where(by_cutoff["m_c"] == m_c).drop("m_c"), f"{out}/links_mc_{m_c}")
    clustered = cut(cluster(catalog, p))
    broken = contract.violations(clustered).collect()  # 50 at most
    if broken:
        raise ValueError(f"clusters break their contract: {broken[:5]}")
    sinks.write_parquet(clustered, f"{out}/clusters")
    sinks.write_training_set(training_set(clustered, p), f"{out}/training")
