"""Checks of a clustered table against its rules: one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
FORBIDDEN = ("aftershock_probability", "risk_level")


def _row_rules() -> dict[str, Column]:
    """True where the rule is broken."""
    c = F.col
    not_in = lambda n, *values: ~F.coalesce(c(n).isin(*values), F.lit(False))
    differ = lambda a, b: ~a.eqNullSafe(b)
    single = c("cluster_type") == "single"
    return {
        "link_type is strong or weak": not_in("link_type", "strong", "weak"),
        "cluster_type is single or family": not_in("cluster_type", "single", "family"),
        "event_role is known": not_in("event_role", "single", "mainshock", "foreshock", "aftershock"),
        "strong links are flagged": differ(c("link_type") == "strong", c("is_strong")),
        "strong links have a parent": c("is_strong") & c("parent_id").isNull(),
        "parents come with eta": c("parent_id").isNotNull() & c("log10_eta").isNull(),
        "is_single follows cluster_type": differ(c("is_single"), single),
        "is_family_member is the opposite": differ(c("is_family_member"), ~c("is_single")),
        "singles have one member": single & (c("cluster_size") != 1),
        "families have more": ~single & (c("cluster_size") < 2),
        "singles have the role single": differ(single, c("event_role") == "single"),
        "singles have no mainshock": single & c("mainshock_id").isNotNull(),
        "families have a mainshock": ~single & c("mainshock_id").isNull(),
        "singles count nobody": single & ((c("foreshock_count") != 0) | (c("aftershock_count") != 0)),
    }


def row_violations(clustered: DataFrame) -> DataFrame:
    """event_id and rule."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in _row_rules().items())), lambda x: x.isNotNull())
    return clustered.select("event_id", F.explode(broken).alias("rule"))


def group_violations(clustered: DataFrame) -> DataFrame:
    """cluster_id and rule."""
    main = F.col("event_role") == "mainshock"
    of_main = lambda c: F.max(F.when(main, F.col(c)))
    spread = lambda c: F.min(c).eqNullSafe(F.max(c))
    g = clustered.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.min("cluster_size").alias("least"), F.max("cluster_size").alias("most"), F.count_if(main).alias("mains"),
        F.count_if(F.col("event_role") == "foreshock").alias("fore"), F.count_if(F.col("event_role") == "aftershock").alias("after"),
        spread("mainshock_id").alias("one_id"), F.max("mainshock_id").alias("id"), of_main("event_id").alias("main_id"),
        F.max("mainshock_time").alias("time"), of_main("sort_time").alias("main_time"),
        F.max("mainshock_magnitude").alias("magnitude"), of_main("magnitude").alias("main_magnitude"),
        F.max("foreshock_count").alias("fore_told"), F.max("aftershock_count").alias("after_told"),
    )
    c, family = F.col, F.col("n") > 1
    rules = {
        "cluster_size is the number of members": (c("least") != c("n")) | (c("most") != c("n")),
        "families have exactly one mainshock": family & (c("mains") != 1),
        "members share one mainshock": family & ~c("one_id"),
        "mainshock_id is the mainshock": family & ~c("id").eqNullSafe(c("main_id")),
        "mainshock_time is the mainshock's": family & ~c("time").eqNullSafe(c("main_time")),
        "mainshock_magnitude is the mainshock's": family & ~F.coalesce(F.abs(c("magnitude") - c("main_magnitude")) <= TOLERANCE, F.lit(False)),
        "foreshock_count is the number of foreshocks": c("fore") != c("fore_told"),
        "aftershock_count is the number of aftershocks": c("after") != c("after_told"),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items())), lambda x: x.isNotNull())
    return g.select("cluster_id", F.explode(broken).alias("rule"))


def violations(clustered: DataFrame, most: int = 50) -> DataFrame:
    """Up to `most` violations of either kind, as a report."""
    rows = row_violations(clustered).select(F.lit("event").alias("of"), F.col("event_id").alias("id"), "rule")
    return rows.unionByName(group_violations(clustered).select(F.lit("cluster").alias("of"), F.col("cluster_id").alias("id"), "rule")).limit(most)


def column_warnings(df: DataFrame, required: list[str]) -> list[str]:
    """What is wrong with the columns: missing ones, and ones that would leak a forecast."""
    missing = [f"missing column {c}" for c in required if c not in df.columns]
    return missing + [f"forbidden column {c}" for c in FORBIDDEN if c in df.columns]
