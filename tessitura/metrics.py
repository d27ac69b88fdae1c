"""Request metrics as aggregates, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import metric_number

REQUEST_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """by, buckets array<long> (cumulative, one for each bound), sum, count."""
    buckets = F.array(*(F.count_if(F.col(value) <= b) for b in sorted(bounds)))
    return df.groupBy(*(by or [])).agg(buckets.alias("buckets"), F.sum(value).alias("sum"), F.count("*").alias("count"))


def counter(df: DataFrame, label: str, declared: tuple[str, ...]) -> DataFrame:
    """label, value; labels that were not declared are dropped."""
    return df.where(F.col(label).isin(*declared)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("value"))


def gauge(df: DataFrame, label: str, value: str, at: Column) -> DataFrame:
    """label, value: the latest."""
    return df.groupBy(F.col(label).alias("label")).agg(F.max_by(value, at).alias("value"))


def counter_text(name: str, help_text: str, label_name: str, counted: DataFrame) -> str:
    rows = counted.orderBy("label").collect()  # one row for each declared label
    return "\n".join([f"# HELP {name} {help_text}", f"# TYPE {name} counter", *(f'{name}{{{label_name}="{r.label}"}} {r.value}' for r in rows)]) + "\n"


def gauge_text(name: str, help_text: str, value: float) -> str:
    return f"# HELP {name} {help_text}\n# TYPE {name} gauge\n{name} {number_text(value)}\n"


def histogram_text(name: str, help_text: str, bounds: tuple[float, ...], summed: DataFrame) -> str:
    r = summed.select("buckets", metric_number(F.coalesce("sum", F.lit(0.0))).alias("sum"), "count").first()
    lines = [f'{name}_bucket{{le="{number_text(b)}"}} {n}' for b, n in zip(sorted(bounds), r["buckets"], strict=True)]
    return "\n".join([f"# HELP {name} {help_text}", f"# TYPE {name} histogram", *lines, f'{name}_bucket{{le="+Inf"}} {r["count"]}', f"{name}_sum {r['sum']}", f"{name}_count {r['count']}"]) + "\n"


def number_text(v: float) -> str:
    """Like ``metric_number``, for one number."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    return f"{v:.6f}".rstrip("0").rstrip(".")
