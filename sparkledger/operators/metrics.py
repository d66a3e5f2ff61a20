"""Operational metrics: selectors, counter rates, histogram quantiles, percentiles, pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SERIES = ["metric", "instance", "series"]
#: Upper bounds of latency buckets in milliseconds.
BOUNDS_MS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def instant(samples: DataFrame, column: str = "value") -> DataFrame:
    """Latest sample of each series; one map-side combined aggregate."""
    return samples.groupBy(*SERIES).agg(F.max_by(column, "ts_ms").alias("value"))


def _increase(samples: DataFrame, by: list[str]) -> DataFrame:
    """Increase of each counter within each group; a fall is a reset and counts from zero."""
    prev = F.lag("value").over(W.partitionBy(*by).orderBy("ts_ms"))
    step = samples.withColumn("prev", prev).withColumn("step", F.when(F.col("prev").isNull(), 0).when(F.col("value") < F.col("prev"), F.col("value")).otherwise(F.col("value") - F.col("prev")))
    return step.groupBy(*by).agg(F.sum("step").alias("increase"))


def increases(samples: DataFrame, low: int, high: int) -> DataFrame:
    """Increase of each counter over (low, high] without extrapolation."""
    return _increase(samples.filter((F.col("ts_ms") > low) & (F.col("ts_ms") <= high)), SERIES)


def rate_by(samples: DataFrame, low: int, high: int, labels: list[str]) -> DataFrame:
    """sum by (labels) of the rates per second."""
    return increases(samples, low, high).groupBy(*labels).agg((F.sum("increase") * 1000.0 / (high - low)).alias("rate"))


def increases_by_window(samples: DataFrame, window_ms: int) -> DataFrame:
    """Increase of each counter over each window (slot * window_ms, (slot + 1) * window_ms] that has samples; the whole range is covered,
    and a long series is sorted window by window."""
    slot = F.floor((F.col("ts_ms") - 1) / window_ms).cast("bigint")
    return _increase(samples.withColumn("slot", slot), [*SERIES, "slot"])


def rate_by_window(samples: DataFrame, window_ms: int, labels: list[str]) -> DataFrame:
    """sum by (labels) of the rates per second in each window."""
    return increases_by_window(samples, window_ms).groupBy(*labels, "slot").agg((F.sum("increase") * 1000.0 / window_ms).alias("rate"))


def buckets(observations: DataFrame, value: str, by: list[str], bounds=BOUNDS_MS) -> DataFrame:
    """Cumulative histogram: observations at or below each bound, and all of them under no bound."""
    counts = observations.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds], F.count("*").alias("le_inf"))
    pairs = ", ".join(f"CAST({b} AS DOUBLE), le_{b}" for b in bounds)
    return counts.selectExpr(*by, f"stack({len(bounds) + 1}, {pairs}, CAST('Infinity' AS DOUBLE), le_inf) AS (le, cum)")


def histogram_quantile(cumulative: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile of cumulative buckets by linear interpolation in the first that reaches it; beyond the last bound, that bound."""
    w = W.partitionBy(*by).orderBy("le")
    at = cumulative.withColumns({"lower": F.lag("le", 1, 0.0).over(w), "below": F.lag("cum", 1, 0).over(w), "total": F.max("cum").over(W.partitionBy(*by))})
    rank = F.lit(q) * F.col("total")
    hit = at.filter((F.col("total") > 0) & (F.col("cum") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0)))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * (rank - F.col("below")) / F.greatest(F.col("cum") - F.col("below"), F.lit(1)))
    return hit.groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def nearest_rank(observations: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95, p99 and the maximum by nearest rank."""
    p = lambda q: F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {value}) AS BIGINT)").alias(f"p{int(q * 100)}")
    return observations.groupBy(*by).agg(p(0.5), p(0.95), p(0.99), F.max(value).alias("highest"))


def throughput(records: DataFrame, window_ms: int) -> DataFrame:
    """Bytes and operations per second of each report interval."""
    slot = F.floor(F.col("ts_ms") / window_ms).cast("bigint").alias("slot")
    return records.groupBy("namespace", slot).agg((F.sum("length") * 1000.0 / window_ms).alias("bytes_per_s"), (F.count("*") * 1000.0 / window_ms).alias("ops_per_s"))


def last_observations(samples: DataFrame, most: int) -> DataFrame:
    """The latest observations of each series, as a ring buffer keeps them."""
    return samples.withColumn("nth", F.row_number().over(W.partitionBy(*SERIES).orderBy(F.desc("ts_ms")))).filter(F.col("nth") <= most).drop("nth")


def paced(requests: DataFrame, cost: str, burst: int, key: list[str], order: str, now: str) -> DataFrame:
    """Start time of each request under a token bucket: the costs before it plus the running maximum of now - burst - costs before."""
    w = W.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = requests.withColumn("_before", before)
    slack = F.max(F.col(now) - burst - F.col("_before")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return at.withColumn("start", F.greatest(F.col(now), F.col("_before") + slack)).drop("_before")


def unhealthy_since(samples: DataFrame, healthy: str, key: list[str], order: str) -> DataFrame:
    """First time of the unhealthy stretch that each unhealthy row is in; a healthy row ends a stretch."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    at = samples.withColumn("_island", F.sum(F.when(F.col(healthy), 1).otherwise(0)).over(w)).filter(~F.col(healthy))
    return at.withColumn("since", F.min(order).over(W.partitionBy(*key, "_island"))).drop("_island")


def matched_product(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left * on(labels) group_left right. The right side must have one row for each label set; several are an error."""
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), F.max("value").alias("_v"))
    one = one.select(*on, F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.lit("several rows on the right of a many-to-one match")).cast("bigint")).alias("factor"))
    return left.join(one, on).withColumn("product", F.col("value") * F.col("factor"))
