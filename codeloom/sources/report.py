"""Reports of question runs: averages per mode, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ["total_tokens", "cost_usd", "response_time_ms"]


def mode_averages(runs: DataFrame) -> DataFrame:
    """One row: for each measure the average of both modes (0 where there are none) and the reduction in percent."""
    wide = runs.groupBy().agg(*[F.coalesce(F.avg(F.when(F.col("mode") == m, F.col(c))), F.lit(0.0)).alias(f"{m}_{c}") for m in ("traditional", "graph") for c in MEASURES])
    reduction = lambda c: F.when(F.col(f"traditional_{c}") > 0, (F.col(f"traditional_{c}") - F.col(f"graph_{c}")) / F.col(f"traditional_{c}") * 100).otherwise(F.lit(0.0))
    return wide.select("*", *[reduction(c).alias(f"{c}_reduction") for c in MEASURES])


def write_csv(runs: DataFrame, path: str) -> None:
    """The runs as CSV with doubled quotes, costs with six decimals; fails if the folder exists."""
    runs.withColumn("cost_usd", F.format_string("%.6f", F.col("cost_usd").cast("double"))).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def markdown(averages: DataFrame) -> DataFrame:
    """One row with the summary table as Markdown."""
    lines = [F.lit("| measure | traditional | graph | reduction |"), F.lit("|---|---|---|---|")]
    lines += [F.format_string(f"| {c} | %.2f | %.2f | %.1f %% |", f"traditional_{c}", f"graph_{c}", f"{c}_reduction") for c in MEASURES]
    return averages.select(F.concat_ws("\n", *lines).alias("markdown"))
