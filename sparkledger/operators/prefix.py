"""Longest valid prefixes of ledgers and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .offsets import KEY


def valid_prefix(entries: DataFrame, bad: Column, order: str = "seq", keys: list[str] = KEY) -> DataFrame:
    """Entries before the first bad one."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("_bad", F.sum(F.when(bad, 1).otherwise(0)).over(w)).filter("_bad = 0").drop("_bad")


def ledger_prefix(entries: DataFrame) -> DataFrame:
    """Valid entries of a ledger whose ends strictly increase."""
    before = W.partitionBy(*KEY).orderBy("seq")
    at = entries.withColumn("_before", F.lag("end_offset", 1, 0).over(before))
    return valid_prefix(at, ~F.col("entry_ok") | (F.col("end_offset") <= F.col("_before"))).drop("_before")


def recover(entries: DataFrame, durable: DataFrame) -> DataFrame:
    """Verified end per file after a crash: entry, data and payload must all be good; the durable offset known before is
    clamped to it."""
    good = valid_prefix(entries, ~(F.col("entry_ok") & F.col("data_present") & F.col("payload_ok")))
    ends = good.groupBy(*KEY).agg(F.max("end_offset").alias("verified_end"), F.count("*").alias("n_entries"))
    all_ = entries.groupBy(*KEY).agg(F.max("end_offset").alias("claimed_end"))
    known = F.least(F.coalesce("durable_offset", F.lit(0)), F.coalesce("verified_end", F.lit(0)))
    return all_.join(ends, KEY, "left").join(durable.select(*KEY, "durable_offset"), KEY, "left").select(*KEY, "claimed_end", known.alias("durable_offset"), F.coalesce("verified_end", F.lit(0)).alias("verified_end"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), (F.coalesce("verified_end", F.lit(0)) < F.col("claimed_end")).alias("truncated"))


def bounded_log_prefix(records: DataFrame, most: int, skip: int = 0) -> DataFrame:
    """Log records up to the first that is too long, after skipping some."""
    return valid_prefix(records, F.col("length") > most).filter(F.col("seq") > skip)
