"""Tables behind reports, and short renderings of them. Tables here have a row per metric or bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.operators import metrics


def comparison_table(deltas: DataFrame) -> str:
    """Markdown of a deltas table: signed changes, worse ones marked."""
    rows = deltas.orderBy("target", "metric", "family").collect()  # one per family, target and metric
    number = lambda x, sign="": "-" if x is None else f"{x:{sign}.4f}"
    lines = ["| target | metric | family | before | after | change |", "|-|-|-|-|-|-|"]
    for r in rows:
        worse = " (worse)" if r.better is False and r.delta else ""
        lines.append(f"| {r.target} | {r.metric} | {r.family} | {number(r.before)} | {number(r.after)} | {number(r.delta, '+')}{worse} |")
    return "\n".join(lines)


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f}%"


def scatter_sample(scores: DataFrame, n: int = 1800) -> DataFrame:
    """Up to n rows with both values, picked by hash, and the axis limit: the 98th percentile plus 5 %."""
    both = scores.where("actual IS NOT NULL AND predicted IS NOT NULL")
    limit = both.agg((F.percentile(F.greatest("actual", "predicted"), 0.98) * 1.05).alias("axis"))
    return both.orderBy(F.xxhash64(*both.columns)).limit(n).join(F.broadcast(limit))  # limit: one row


def html_report(title: str, long: DataFrame, scores: DataFrame) -> str:
    """A plain page: metrics by family and target, and the reliability curve."""
    table = lambda head, rows: f"<table><tr>{''.join(f'<th>{h}</th>' for h in head)}</tr>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in r) + '</tr>' for r in rows)}</table>"
    show = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    values = [[show(c) for c in r] for r in long.select("family", "target", "metric", "value").orderBy("target", "metric", "family").collect()]
    curve = [[show(c) for c in r] for r in metrics.reliability(scores, ["family", "target"]).orderBy("family", "target", "bin").collect()]
    return f"<!DOCTYPE html><title>{title}</title><h1>{title}</h1>{table(['family', 'target', 'metric', 'value'], values)}<h2>Reliability</h2>{table(['family', 'target', 'bin', 'n', 'mean', 'observed'], curve)}"
