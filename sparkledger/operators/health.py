"""Replica and node health, repair plans and integrity invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .votes import CHUNK


def small(side: DataFrame, most: int = 500_000) -> DataFrame:
    """A side that is broadcast if it was counted to have no more rows than this, as a cluster's nodes or namespaces have: the rows it
    is joined to then stay where they are."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def with_nodes(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas with what is known of their node; an unknown node is dead."""
    side = nodes.select("node_id", "host", "endpoint", F.col("state").alias("node_state"))
    return replicas.join(small(side), "node_id", "left").withColumn("node_state", F.coalesce("node_state", F.lit("DEAD")))


def liveness(nodes: DataFrame, now: int, grace: int) -> DataFrame:
    """alive, suspect or dead of each registered node; draining ones are in none of these."""
    state = F.when(F.col("state") == "DEAD", "dead").when(F.col("state") != "REGISTERED", "none").when(F.col("lease_until_ms") >= now, "alive").when(F.try_add("lease_until_ms", F.lit(grace)) >= now, "suspect").otherwise("dead")
    return nodes.withColumn("liveness", state)


def census(replicas: DataFrame, nodes: DataFrame, rf: int) -> DataFrame:
    """Live replicas per chunk and its class: unavailable, at minimum redundancy, under-replicated or full."""
    live = with_nodes(replicas, nodes).groupBy(*CHUNK).agg(F.count_if(F.col("node_state") != "DEAD").alias("live"), F.count("*").alias("members"))
    kind = F.when(F.col("live") == 0, "unavailable").when((F.col("live") < rf) & (F.col("live") == 1), "at_min").when(F.col("live") < rf, "under").otherwise("full")
    return live.withColumn("class", kind)


def matches(report_state: str = "r_state") -> Column:
    """A reported replica is healthy: sealed, of the right length and checksum."""
    return (F.col(report_state) == "SEALED") & F.col("r_length").eqNullSafe(F.col("length")) & F.col("r_crc").eqNullSafe(F.col("crc"))


def verdicts(replicas: DataFrame, reports: DataFrame, nodes: DataFrame, now: int, grace: int, since: DataFrame, protected: DataFrame) -> DataFrame:
    """What to do with each replica of a sealed chunk by its node's report, never dropping the last live one.

    Only nodes that live answer; without a report of theirs the replica is missing. Replicas are judged in the order of their
    nodes: a bad one stays if no other member lives that was not dropped before it in this pass, waits until it has been bad
    for the grace (since: replica, since_ms; not there: only now), and is left alone while a repair protects it.
    """
    got = reports.select(*CHUNK, "node_id", F.col("state").alias("r_state"), F.col("length").alias("r_length"), F.col("crc").alias("r_crc"))
    at = with_nodes(replicas.filter("state = 'SEALED'"), nodes).withColumn("live", F.col("node_state") != "DEAD").join(got, [*CHUNK, "node_id"], "left")
    at = at.join(since.select(*CHUNK, "node_id", "since_ms"), [*CHUNK, "node_id"], "left").join(protected.select(*CHUNK, "node_id").distinct().withColumn("safe", F.lit(True)), [*CHUNK, "node_id"], "left")
    healthy, reseal = F.coalesce(matches(), F.lit(False)), F.coalesce((F.col("r_state") == "OPEN") & (F.col("r_length") >= F.col("length")), F.lit(False))
    due = F.lit(now) - F.coalesce("since_ms", F.lit(now)) >= grace
    bad = F.col("live") & F.col("safe").isNull() & ~healthy & ~reseal
    w = W.partitionBy(*CHUNK)
    before = F.coalesce(F.sum(F.when(bad & due, 1).otherwise(0)).over(w.orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("others", F.count_if("live").over(w) - F.when(F.col("live"), 1).otherwise(0) - before)
    drop = F.when(F.col("r_state").isNull(), "drop-missing").when(F.col("r_state") != "SEALED", "drop-not-sealed").otherwise("drop-corrupt")
    verdict = F.when(~F.col("live"), "no-answer").when(F.col("safe"), "protected").when(healthy, "healthy").when(reseal, "reseal").when(F.col("others") <= 0, "keep-last-live").when(~due, "in-grace").otherwise(drop)
    return at.select(*CHUNK, "node_id", verdict.alias("verdict"))


def readable(replicas: DataFrame, reports: DataFrame, quorum: int) -> DataFrame:
    """Replicas per sealed chunk that match its descriptor, and whether they are a quorum or all."""
    got = reports.select(*CHUNK, "node_id", F.col("state").alias("r_state"), F.col("length").alias("r_length"), F.col("crc").alias("r_crc"))
    at = replicas.filter("state = 'SEALED'").join(got, [*CHUNK, "node_id"], "left")
    ok = F.coalesce(matches(), F.lit(False))
    return at.groupBy(*CHUNK).agg(F.count_if(ok).alias("readable"), F.count("*").alias("members")).withColumns({"quorum": F.col("readable") >= quorum, "full": F.col("readable") == F.col("members")})


def repair_candidates(replicas: DataFrame, nodes: DataFrame, rf: int) -> DataFrame:
    """Chunks to repair, the least live ones first: one action swaps the first dead member or adds one; nothing without a live source."""
    at = with_nodes(replicas, nodes)
    dead = F.col("node_state") == "DEAD"
    per = at.groupBy(*CHUNK).agg(F.count_if(~dead).alias("live"), F.count("*").alias("members"), F.min(F.when(dead, F.col("node_id"))).alias("dead_node"), F.min(F.when(~dead, F.col("node_id"))).alias("source_node"))
    todo = per.filter((F.col("live") > 0) & ((F.col("live") < F.col("members")) | (F.col("members") < rf)))
    return todo.withColumn("action", F.when(F.col("dead_node").isNotNull(), "SWAP").otherwise("ADD"))


def file_violations(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that break the shape of a live file: indexes without gaps, an open chunk only as the last one, lengths not negative."""
    w = W.partitionBy("namespace", "file_id").orderBy("idx")
    at = chunks.join(files.filter("state <> 'DELETED'").select("namespace", "file_id"), ["namespace", "file_id"], "left_semi")
    at = at.withColumns({"place": F.row_number().over(w) - 1, "next": F.lead("idx").over(w)})
    reason = F.when(F.col("idx") != F.col("place"), "gap").when((F.col("state") == "OPEN") & F.col("next").isNotNull(), "open-inside").when(F.col("length") < 0, "length")
    return at.withColumn("reason", reason).filter("reason IS NOT NULL").select("namespace", "file_id", "idx", "reason")


def bad_replica_sets(replicas: DataFrame, rf: int) -> DataFrame:
    """Chunks whose replicas are not rf distinct nodes."""
    per = replicas.groupBy(*CHUNK).agg(F.collect_list("node_id").alias("ids"))
    return per.filter((F.size("ids") != F.size(F.array_distinct("ids"))) | (F.size("ids") != rf)).select(*CHUNK, F.size("ids").cast("bigint").alias("n"))


def identical_replicas(blobs: DataFrame, key: str, content: str) -> DataFrame:
    """Copies per key and whether their bytes agree, by SHA-256; hot keys are combined before the shuffle."""
    return blobs.select(key, F.sha2(content, 256).alias("digest")).groupBy(key).agg(F.count("*").alias("copies"), (F.min("digest") == F.max("digest")).alias("identical"))


def acked_not_readable(acked: DataFrame, readable_: DataFrame) -> DataFrame:
    """Acknowledged appends that no readable record answers for, by offset and digest."""
    return acked.join(readable_, ["namespace", "file_id", "end_offset", "digest"], "left_anti")


def delete_drive(files: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next step of deleting files: delete the replicas on nodes that live, count those on dead nodes as gone, drop a file without chunks."""
    going = files.filter("state = 'DELETING'").select("namespace", "file_id")
    at = with_nodes(replicas, nodes)
    per = at.groupBy("namespace", "file_id").agg(F.count_if(F.col("node_state") != "DEAD").alias("to_delete"), F.count_if(F.col("node_state") == "DEAD").alias("implicit"))
    out = going.join(per, ["namespace", "file_id"], "left").na.fill(0, ["to_delete", "implicit"])
    return out.withColumn("step", F.when(F.col("to_delete") + F.col("implicit") == 0, "DROP_FILE").when(F.col("to_delete") == 0, "CONFIRM").otherwise("DELETE_REPLICAS"))
