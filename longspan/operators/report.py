"""Tables behind circular and radar charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def circular_bars(quality: DataFrame, baseline: float) -> DataFrame:
    """Label, place and angle on a circle, and height over a baseline, by rising AUROC.

    `quality(site, method, auroc)` has one row per bar, so one window over all of them is small.
    """
    place = F.row_number().over(W.orderBy("auroc", "site", "method"))
    bars = F.count("*").over(W.partitionBy())
    return quality.select(
        F.concat_ws(" - ", "site", "method").alias("label"),
        place.alias("id"),
        (90 - 360 * (place - 0.5) / bars).alias("angle"),
        "auroc",
        (F.col("auroc") - F.lit(baseline)).alias("height"),
    )


def radar_rows(
    quality: DataFrame, chart: str, series: str, metrics: Sequence[str], low: float, high: float
) -> DataFrame:
    """Per chart the upper bound, the lower bound and the series, in that order."""
    charts = quality.select(chart).distinct()

    def bound(name: str, order: int, value: float) -> DataFrame:
        return charts.select(
            chart, F.lit(name).alias("series"), F.lit(order).alias("position"),
            *[F.lit(float(value)).alias(m) for m in metrics],
        )

    position = F.row_number().over(W.partitionBy(chart).orderBy(series)) + 2
    rows = quality.select(chart, F.col(series).alias("series"), position.alias("position"), *metrics)
    return bound("max", 1, high).unionByName(bound("min", 2, low)).unionByName(rows)
