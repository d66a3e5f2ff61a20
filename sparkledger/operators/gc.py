"""Garbage collection and retention plans; their rows are intended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .health import small


def orphan_verdicts(suspects: DataFrame, descriptors: DataFrame, reachable: DataFrame) -> DataFrame:
    """ORPHAN where the owner answers and does not list the replica, KEEP where it does, UNREACHABLE without an answer."""
    listed = descriptors.select("namespace", "file_id", "idx", "node_id").distinct().withColumn("listed", F.lit(True))
    at = suspects.join(listed, ["namespace", "file_id", "idx", "node_id"], "left").join(small(reachable.select("namespace").distinct()).withColumn("answers", F.lit(True)), "namespace", "left")
    return at.withColumn("verdict", F.when(F.col("answers").isNull(), "UNREACHABLE").when(F.col("listed"), "KEEP").otherwise("ORPHAN")).drop("listed", "answers")


def budgets(counts: DataFrame, per_namespace: int, percent: int, per_node: int) -> DataFrame:
    """Deletions allowed per namespace in order: by number, by share of sealed chunks (at least one), and by what the node has
    left after the namespaces before. A limit of 0 is no limit; without sealed chunks the share allows none.

    counts: node_id, namespace, orphans, sealed.
    """
    share = F.when(F.col("sealed") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("sealed") * percent / 100)))
    terms = [F.col("orphans")] + ([F.lit(per_namespace)] if per_namespace else []) + ([share] if percent else [])
    want = F.least(*terms) if len(terms) > 1 else terms[0]
    at = counts.withColumn("want", want.cast("bigint"))
    before = F.coalesce(F.sum("want").over(W.partitionBy("node_id").orderBy("namespace").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    allowed = F.greatest(F.lit(0), F.least(F.col("want"), F.lit(per_node) - before)) if per_node else F.col("want")
    return at.withColumn("allowed", allowed.cast("bigint"))


def parse_system_path(df: DataFrame, column: str = "path") -> DataFrame:
    """namespace, generation and kind of a system file's path of exactly five parts; null, which keeps the file, for any other."""
    parts = F.split(F.col(column), "/")
    ok = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "") & (F.get(parts, F.lit(1)) == "metadata-log") & F.get(parts, F.lit(3)).rlike("^gen-[0-9]+$")
    return df.withColumns({
        "p_namespace": F.when(ok, F.get(parts, F.lit(2))),
        "p_generation": F.when(ok, F.substring(F.get(parts, F.lit(3)), 5, 30).try_cast("bigint")),
        "p_kind": F.when(ok, F.substring_index(F.get(parts, F.lit(4)), "-", 1)),
    })


def superseded_system_files(files: DataFrame, manifests: DataFrame, now: int, retention: int) -> DataFrame:
    """System files to reap: not referenced by the manifest of their namespace, of no later generation than it, and of a
    generation whose successor is older than the retention. Without a manifest or a parsed path a file stays."""
    at = parse_system_path(files).filter("p_generation IS NOT NULL")
    refs = manifests.select(F.explode(F.array("log_file_id", "snapshot_file_id")).alias("file_id"))
    current = manifests.select(F.col("namespace").alias("p_namespace"), F.col("generation").alias("published"))
    born = at.groupBy("p_namespace", "p_generation").agg(F.min("created_ms").alias("next_born")).withColumn("p_generation", F.col("p_generation") - 1)
    old = at.join(refs, "file_id", "left_anti").join(current, "p_namespace").filter("p_generation <= published").join(born, ["p_namespace", "p_generation"])
    return old.filter(F.col("next_born") + retention <= now).select("file_id", F.col("p_namespace").alias("namespace"), F.col("p_generation").alias("generation"))


def expired_tombstones(files: DataFrame, cutoff: int | Column) -> DataFrame:
    """Tombstones to sweep; the cutoff itself has expired."""
    return files.filter((F.col("state") == "DELETED") & (F.col("deleted_ms") <= cutoff))


def protected_suspects(chunks: DataFrame, now: int, grace: int) -> DataFrame:
    """Sealed local chunks past their protection and not verified within the grace."""
    return chunks.filter((F.col("state") == "SEALED") & (F.lit(now) >= F.col("protected_until_ms")) & (F.lit(now) - F.col("last_verified_ms") >= grace))


def timed_out(issued: DataFrame, completed: DataFrame, now: int | Column, timeout: int) -> DataFrame:
    """Commands in flight to abandon: not completed, and issued too long ago."""
    return issued.join(completed.select("command_id"), "command_id", "left_anti").filter(F.lit(now) - F.col("issued_ms") > timeout)
