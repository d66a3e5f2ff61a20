"""Majority votes and recovery decisions over replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = ["namespace", "file_id", "idx"]


def seal_votes(votes: DataFrame, quorum: int) -> DataFrame:
    """The (length, crc) that most replicas agree on, if a quorum does; ties go to the vote cast first."""
    tally = votes.groupBy(*CHUNK, "final_length", "crc").agg(F.count("*").alias("n"), F.min("vote_seq").alias("first"), F.sort_array(F.collect_set("node_id")).alias("nodes"))
    w = W.partitionBy(*CHUNK)
    ranked = tally.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "first")), "keys": F.count("*").over(w), "total": F.sum("n").over(w)})
    return ranked.filter((F.col("rank") == 1) & (F.col("n") >= quorum)).select(*CHUNK, "final_length", "crc", "n", F.array_join("nodes", ",").alias("nodes"), "total", (F.col("keys") > 1).alias("divergent"))


def agreement(votes: DataFrame, quorum: int, replicas: int) -> DataFrame:
    """Recovery verdict per chunk. A value with a quorum of holders wins; else a single value may, if the replicas that were
    not heard could still make a quorum with its holders; values that differ are a conflict."""
    tally = votes.groupBy(*CHUNK, "final_length", "crc").agg(F.count("*").alias("n"))
    per = tally.groupBy(*CHUNK).agg(F.max("n").alias("best"), F.count("*").alias("n_values"), F.sum("n").alias("heard"))
    unheard = F.lit(replicas) - F.col("heard")
    verdict = (
        F.when(F.col("best") >= quorum, "QUORUM").when((F.col("n_values") == 1) & (F.col("best") + unheard >= quorum), "CREDITED").when(F.col("n_values") > 1, "CONFLICT").otherwise("NONE")
    )
    return per.select(*CHUNK, "best", "n_values", unheard.alias("unheard"), verdict.alias("verdict"))


def farthest_boundary(acks: DataFrame, quorum: int, key: list[str]) -> DataFrame:
    """The farthest record end that a quorum of replicas holds, with how many do."""
    held = acks.groupBy(*key, "end_offset").agg(F.count_distinct("node_id").alias("holders")).filter(F.col("holders") >= quorum)
    return held.groupBy(*key).agg(F.max("end_offset").alias("boundary"), F.max_by("holders", "end_offset").alias("holders"))


def evict_short(reports: DataFrame, floors: DataFrame, quorum: int) -> DataFrame:
    """Sealed replicas shorter than the durable floor are evicted; whether a quorum is left."""
    at = reports.join(floors, CHUNK)
    short = (F.col("state") == "SEALED") & (F.col("length") < F.col("floor"))
    return at.groupBy(*CHUNK).agg(F.count_if(short).alias("evicted"), F.count_if(~short).alias("left")).withColumn("recoverable", F.col("left") >= quorum)


def append_decisions(outcomes: DataFrame, quorum: int) -> DataFrame:
    """What an appender does on the outcomes of a round: die when fenced or short of a quorum, roll when sealed, else go on."""
    per = outcomes.groupBy("namespace", "file_id", "seq").agg(F.count_if(F.col("outcome") == "FENCED").alias("fenced"), F.count_if(F.col("outcome") == "SEALED").alias("sealed"), F.count_if(F.col("outcome") == "OK").alias("live"))
    return per.withColumn("decision", F.when(F.col("fenced") > 0, "DIE").when(F.col("sealed") > 0, "ROLL").when(F.col("live") < quorum, "DIE").when(F.col("live") < 3, "FAIL_REPLICA").otherwise("CONTINUE"))
