"""Operations on one replica of a chunk, and how recovery judges what replicas hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .control import codes
from .votes import CHUNK

REPLICA = [*CHUNK, "node_id"]


def seal_codes(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Outcome of sealing replicas at a length: the fence comes first, the same length again is fine, never beyond the end nor
    below what is known to be durable.

    requests: replica, epoch, data_length; states: state, local_end, last_known_do, write_epoch, fence_epoch, sealed_length.
    """
    at = requests.join(states, REPLICA, "left")
    sealed = F.col("state") == "SEALED"
    code = codes(
        (F.col("state").isNull(), "CHUNK_NOT_FOUND"), (F.col("epoch") < F.greatest("fence_epoch", "write_epoch"), "FENCED_EPOCH"), (sealed & (F.col("sealed_length") == F.col("data_length")), "OK"),
        (sealed, "CHUNK_SEALED"), (F.col("data_length") > F.col("local_end"), "INTERNAL"), (F.col("data_length") < F.col("last_known_do"), "INTERNAL"), (F.col("state") == "DELETING", "CHUNK_NOT_FOUND"),
    )
    return at.select(*REPLICA, "data_length", code.alias("code"))


def open_codes(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Opening replicas: one that is there already is refused; of requests for the same replica the first opens it."""
    there = states.select(*REPLICA).distinct().withColumn("there", F.lit(True))
    first = F.row_number().over(W.partitionBy(*REPLICA).orderBy("request"))
    return requests.join(there, REPLICA, "left").withColumn("_n", first).select("request", *REPLICA, codes((F.col("there") | (F.col("_n") > 1), "CHUNK_ALREADY_EXISTS")).alias("code"))


def delete_codes(requests: DataFrame, states: DataFrame) -> DataFrame:
    there = states.select(*REPLICA).distinct().withColumn("there", F.lit(True))
    return requests.join(there, REPLICA, "left").select(*REPLICA, codes((F.col("there").isNull(), "CHUNK_NOT_FOUND")).alias("code"))


def fetch_pages(states: DataFrame, page: int) -> DataFrame:
    """Pages of the raw bytes of sealed replicas; an empty one has none."""
    sealed = states.filter("state = 'SEALED' AND sealed_length > 0")
    at = sealed.select(*REPLICA, "sealed_length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sealed_length") - 1, F.lit(page).cast("bigint"))).alias("offset"))
    return at.select(*REPLICA, "offset", F.least(F.lit(page).cast("bigint"), F.col("sealed_length") - F.col("offset")).alias("n_bytes"))


def footer_stats(entries: DataFrame, lengths: DataFrame, key: list[str]) -> DataFrame:
    """What a footer says of the sealed length: the entries that end within it, and the last such end."""
    at = entries.join(lengths.select(*key, F.col("length").alias("sealed")), key)
    return at.groupBy(*key, "sealed").agg(F.max(F.when(F.col("end_offset") <= F.col("sealed"), F.col("end_offset"))).alias("last_end"), F.count_if(F.col("end_offset") <= F.col("sealed")).alias("entries"))


def sane_responses(responses: DataFrame) -> DataFrame:
    """Fence and read responses that can be true: 0 <= durable offset <= end."""
    return responses.filter("0 <= last_known_do AND last_known_do <= local_end")


def durable_floor(responses: DataFrame) -> DataFrame:
    """The highest durable offset that a chunk's replicas know of."""
    return sane_responses(responses).groupBy(*CHUNK).agg(F.max("last_known_do").alias("floor"))


def flush_due(states: DataFrame, threshold: int) -> DataFrame:
    """Replicas with at least so many bytes that are not flushed."""
    return states.filter(F.col("local_end") - F.col("flushed") >= threshold)


def chosen_response(responses: DataFrame) -> DataFrame:
    """The response a reader takes: the first attempt that is valid.

    Refused are failures, durable offsets beyond the end, more bytes than were asked for, bytes beyond the visible end, and
    empty reads of a sealed chunk before its length.
    responses: request, attempt, node_id, ok, sealed, at_offset, want, got, end_at, durable.
    """
    visible = F.when(F.col("sealed"), F.col("end_at")).otherwise(F.least("end_at", "durable"))
    valid = F.col("ok") & F.col("durable").between(0, F.col("end_at")) & (F.col("got") <= F.col("want")) & (F.col("at_offset") + F.col("got") <= visible) & ~(F.col("sealed") & (F.col("got") == 0) & (F.col("at_offset") < F.col("end_at")) & (F.col("want") > 0))
    first = responses.groupBy("request").agg(F.min_by(F.struct("attempt", "node_id", "got"), F.when(valid, F.col("attempt"))).alias("x"), F.count("*").alias("attempts"))
    return first.select("request", "attempts", "x.attempt", "x.node_id", "x.got")


def restart_class(probes: DataFrame) -> DataFrame:
    """What a chunk on disk is at restart: sealed if its trailer is valid and a ledger that is left ends at the data's length; a
    broken trailer without anything else is corrupt; else open, by its sidecar or rebuilt from the ledger, or quarantined.

    probes: trailer_ok, trailer_like, has_sidecar, sidecar_ok, has_ledger, ledger_end, data_length.
    """
    sealed = F.col("trailer_ok") & (~F.col("has_ledger") | (F.col("ledger_end") == F.col("data_length")))
    kind = (
        F.when(sealed, "SEALED").when(~F.col("trailer_ok") & ~F.col("has_sidecar") & ~F.col("has_ledger") & F.col("trailer_like"), "CORRUPT").when(F.col("has_sidecar") & F.col("sidecar_ok"), "OPEN")
        .when(F.col("has_ledger"), "REBUILT").otherwise("QUARANTINED")
    )
    return probes.withColumn("class", kind)


def raw_image_faults(images: DataFrame) -> DataFrame:
    """Faults of a chunk's raw image against its descriptor; none leaves an empty list. Also what an import checks."""
    checks = {
        "header-id": "header_id <> chunk_id", "trailer-length": "trailer_length <> length", "data-crc": "data_crc <> crc", "trailer-crc": "trailer_crc <> crc",
        "footer-start": "footer_start <> header_size + length", "footer-overlap": "footer_start > trailer_offset", "footer-crc": "footer_crc <> trailer_footer_crc",
    }
    return images.withColumn("faults", F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + "))"))


def catch_up(holdings: DataFrame, quorum: int) -> DataFrame:
    """What to catch a replica up with: bytes that a quorum of donors holds, else the only ones held; donors that differ are an error.

    holdings: chunk, node_id, end_at, to_offset, digest (null if unreadable).
    """
    votes = holdings.filter("end_at >= to_offset AND digest IS NOT NULL").groupBy(*CHUNK, "digest").agg(F.count_distinct("node_id").alias("n"))
    per = votes.groupBy(*CHUNK).agg(F.count("*").alias("values"), F.max("n").alias("best"), F.max_by("digest", F.struct("n", "digest")).alias("digest"))
    outcome = F.when(F.col("best") >= quorum, "QUORUM").when(F.col("values") > 1, "CORRUPT_CHUNK").otherwise("SINGLE")
    return per.select(*CHUNK, outcome.alias("outcome"), F.when(outcome != "CORRUPT_CHUNK", F.col("digest")).alias("digest"))


def conflicts(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that a readable replica contradicts above the floor: records of both that end at the same offset between the
    floor and the candidate's end, with other bytes.

    records: chunk, node_id, end_offset, digest; candidates: chunk, node_id, floor, end.
    """
    own = candidates.join(records, [*CHUNK, "node_id"]).filter("end_offset > floor AND end_offset <= end").select(*CHUNK, F.col("node_id").alias("candidate"), "end_offset", F.col("digest").alias("own"))
    other = own.join(records, [*CHUNK, "end_offset"]).filter("node_id <> candidate")
    return other.groupBy(*CHUNK, "candidate").agg(F.count_if(F.col("digest") != F.col("own")).alias("differ")).withColumn("conflict", F.col("differ") > 0)


def as_of(events: DataFrame, known: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """events with the last value known at their time: one union and one window, no range join. At the same time the value counts."""
    both = known.select(*key, at, F.col(value).alias("_v"), F.lit(0).alias("_e")).unionByName(events.withColumns({"_v": F.lit(None).cast(dict(known.dtypes)[value]), "_e": F.lit(1)}), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(at, "_e").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).filter("_e = 1").drop("_v", "_e")


def piggybacked(appends: DataFrame, key: list[str], order: str) -> DataFrame:
    """The durable offset a replica knows after each append: told ones count up to the end before the append and never go back."""
    w = W.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return appends.withColumn("_before", before).withColumn("known", F.max(F.least("told", "_before")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_before")


def resurrections(log: DataFrame) -> DataFrame:
    """Files that a record without a creation brings back after their deletion: histories must have none."""
    w = W.partitionBy("namespace", "file_id").orderBy("log_offset").rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("kind").isin("FileCreated", "FileDeleted", "TombstoneSwept"), F.col("kind"))
    return log.withColumn("_mark", F.last(mark, True).over(w)).filter("kind IN ('FileSealed', 'FileDeleting', 'ChunkCreated') AND _mark IN ('FileDeleted', 'TombstoneSwept')").select("namespace", "file_id", "log_offset", "kind")


def missing_keys(lines: DataFrame, required: list[str]) -> DataFrame:
    """Artifacts (artifact, value lines of key=value) that lack a required key; a key without a value does not count."""
    have = lines.select("artifact", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.expr("trim(substring(value, instr(value, '=') + 1))").alias("v")).filter("instr(value, '=') > 0 AND v <> ''").select("artifact", "key").distinct()
    every = lines.select("artifact").distinct().select("artifact", F.explode(F.array(*[F.lit(k) for k in required])).alias("key"))
    return every.join(have, ["artifact", "key"], "left_anti")
