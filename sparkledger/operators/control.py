"""Requests against descriptors and nodes: each gives one code or one row of intended events per request, by joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .votes import CHUNK

FILE = ["namespace", "file_id"]


def codes(*cases: tuple[Column, str]) -> Column:
    """The code of the first case that holds, else OK."""
    out = None
    for condition, code in cases:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out.otherwise("OK")


def fan_out(records: DataFrame, replicas: DataFrame, key: list[str]) -> DataFrame:
    """The acknowledgements to expect: every record at every live replica of its chunk."""
    return records.join(replicas.filter("live").select(*key, "node_id"), key)


def abort_codes(requests: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Aborting a chunk: only an open tail, by the request and epoch that made it. What is gone already is aborted.

    requests: file, idx, write_epoch, op; files: state, writer_epoch; chunks: idx, state, write_epoch, op.
    """
    tail = chunks.groupBy(*FILE).agg(F.max_by(F.struct("idx", "state", "write_epoch", "op"), "idx").alias("tail"), F.collect_set("idx").alias("all"))
    at = requests.join(files.select(*FILE, F.col("state").alias("f_state"), "writer_epoch"), FILE, "left").join(tail, FILE, "left")
    gone = F.col("f_state").isNull() | F.col("f_state").eqNullSafe("DELETED")
    code = codes(
        (gone, "OK"), (F.col("f_state") == "DELETING", "PRECONDITION_FAILED"), (F.col("tail").isNull(), "OK"),
        ((F.col("tail.idx") != F.col("idx")) & ~F.array_contains("all", F.col("idx")), "OK"), (F.col("tail.idx") != F.col("idx"), "PRECONDITION_FAILED"),
        (F.col("tail.state") != "OPEN", "PRECONDITION_FAILED"), (F.col("write_epoch") < F.col("writer_epoch"), "FENCED_EPOCH"),
        ((F.col("tail.write_epoch") != F.col("write_epoch")) | (F.col("tail.op") != F.col("op")), "FENCED_EPOCH"),
    )
    return at.select(*requests.columns, code.alias("code"), (~gone & F.col("tail.idx").eqNullSafe(F.col("idx")) & (code == "OK")).alias("aborts"))


def mark_deleting(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Events of deletion requests (namespace, file_id): none for a file that is deleted, being deleted, or not there."""
    live = files.filter("state IN ('OPEN', 'SEALED')").join(requests.select(*FILE).distinct(), FILE, "left_semi")
    return live.select(*FILE, "path", F.explode(F.array(F.lit("FileDeleting"), F.lit("PathUnbound"))).alias("kind"))


def finish_delete(files: DataFrame, bindings: DataFrame, chunks: DataFrame, now: int) -> DataFrame:
    """Events that end a deletion: deleting files without chunks become tombstones, their path unbound if still theirs."""
    going = files.filter("state = 'DELETING'").join(chunks.select(*FILE).distinct(), FILE, "left_anti")
    bound = bindings.select("namespace", "path", F.col("file_id").alias("bound"))
    at = going.select(*FILE, "path").join(bound, ["namespace", "path"], "left")
    kinds = F.when(F.col("bound").eqNullSafe(F.col("file_id")), F.array(F.lit("PathUnbound"), F.lit("FileDeleted"))).otherwise(F.array(F.lit("FileDeleted")))
    return at.select(*FILE, F.explode(kinds).alias("kind"), F.lit(now).cast("bigint").alias("at_ms"))


def blank(x: str) -> Column:
    return F.col(x).isNull() | (F.trim(F.col(x)) == "")


def valid_registration() -> Column:
    """A positive id, endpoints of host and port, topology, positive capacity."""
    ends = F.coalesce(F.forall("endpoints", lambda e: e.rlike("^[^:\\s]+:[0-9]{1,5}$") & F.substring_index(e, ":", -1).try_cast("int").between(1, 65535)), F.lit(False))
    return (F.col("node_id") >= 1) & (F.size("endpoints") > 0) & ends & ~blank("zone") & ~blank("rack") & ~blank("host") & (F.coalesce("capacity_bytes", F.lit(0)) > 0)


def register_codes(requests: DataFrame, nodes: DataFrame, now: int, grace: int) -> DataFrame:
    """Outcome of registrations: refused if invalid, or if another incarnation holds the id within its lease and grace; else
    the session starts anew.

    requests: node_id, incarnation, endpoints, zone, rack, host, capacity_bytes; nodes: node_id, incarnation, lease_until_ms.
    """
    held = nodes.select("node_id", F.col("incarnation").alias("held_by"), "lease_until_ms")
    at = requests.join(held, "node_id", "left")
    other = F.col("held_by").isNotNull() & (F.col("held_by") != F.col("incarnation")) & (F.try_add("lease_until_ms", F.lit(grace)) >= now)
    return at.select(*requests.columns, codes((~valid_registration(), "PRECONDITION_FAILED"), (F.coalesce(other, F.lit(False)), "PRECONDITION_FAILED")).alias("code"))


def published_nodes(nodes: DataFrame, now: int) -> DataFrame:
    """The snapshot of nodes that live: registered, with a lease."""
    return nodes.filter((F.col("state") == "REGISTERED") & (F.col("lease_until_ms") >= now)).select("node_id", "host", "free_bytes", F.lit(now).cast("bigint").alias("published_ms"))


def snapshot_valid(published: Column, now: int, lease: int, grace: int) -> Column:
    """A snapshot counts for a lease and twice the grace."""
    return F.lit(now) - published < lease + 2 * grace


def candidates(memory: DataFrame, snapshot: DataFrame, now: int, lease: int, grace: int) -> DataFrame:
    """Nodes to place on: the eligible ones known here, and from a valid snapshot those that are not; what is known here wins."""
    own = memory.filter((F.col("state") == "REGISTERED") & (F.try_add("lease_until_ms", F.lit(grace)) >= now)).select("node_id", "free_bytes", F.lit(0).alias("_from"))
    theirs = snapshot.filter(snapshot_valid(F.col("published_ms"), now, lease, grace)).select("node_id", "free_bytes", F.lit(1).alias("_from"))
    best = own.union(theirs).groupBy("node_id").agg(F.min_by("free_bytes", "_from").alias("free_bytes"), F.min("_from").alias("_from"))
    return best.select("node_id", "free_bytes", F.when(F.col("_from") == 0, "memory").otherwise("snapshot").alias("source"))


def accepted_completions(completions: DataFrame, inflight: DataFrame, sessions: DataFrame) -> DataFrame:
    """Completions that count, once per command: of a command in flight, by the node it was given to, in that node's session.

    A completion is delivered until it is accepted, so repeats are expected; the first one counts.
    """
    at = completions.join(inflight, "command_id").filter("node_id = executing_node").join(sessions.select("node_id", F.col("session_epoch").alias("current")), "node_id").filter("session_epoch = current")
    first = at.groupBy("command_id").agg(F.min_by(F.struct("node_id", "status", "at_ms"), F.struct("at_ms", "status")).alias("x"))
    return first.select("command_id", "x.*")


def swap_outcomes(actions: DataFrame, files: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a finished copy does to its chunk: nothing if the target is dead or a member already, or the file is being deleted;
    swap with the dead member, or grow while short of the replication factor.

    actions: chunk, dead_node (null to add), target_node.
    """
    members = replicas.groupBy(*CHUNK).agg(F.collect_set("node_id").alias("members"))
    dead = nodes.filter("state = 'DEAD'").select(F.col("node_id").alias("target_node"), F.lit(True).alias("dead"))
    at = actions.join(members, CHUNK, "left").join(files.select(*FILE, "state", "replication_factor"), FILE, "left").join(dead, "target_node", "left")
    has = lambda c: F.coalesce(F.array_contains("members", F.col(c)), F.lit(False))
    outcome = (
        F.when(F.col("dead"), "TARGET_DEAD").when(F.col("state").isNull() | (F.col("state") == "DELETED") | F.col("members").isNull(), "GONE").when(F.col("state") == "DELETING", "DELETING").when(has("target_node"), "MEMBER")
        .when(F.col("dead_node").isNotNull() & has("dead_node"), "SWAPPED").when(F.col("dead_node").isNull() & (F.size("members") < F.col("replication_factor")), "ADDED").otherwise("UNCHANGED")
    )
    return at.select(*actions.columns, outcome.alias("outcome"))


def confirm_deletes(confirmed: DataFrame, files: DataFrame, replicas: DataFrame) -> DataFrame:
    """Chunks after replicas were deleted: what is left, and whether the chunk's record goes. Only a deleting file loses a chunk
    without replicas; a live one keeps it."""
    per = replicas.join(confirmed.select(*CHUNK, "node_id").distinct().withColumn("gone", F.lit(True)), [*CHUNK, "node_id"], "left").groupBy(*CHUNK).agg(F.count_if(F.col("gone").isNull()).alias("left"), F.count_if("gone").alias("removed"))
    at = per.filter("removed > 0").join(files.filter("state <> 'DELETED'").select(*FILE, "state"), FILE)
    return at.select(*CHUNK, "left", F.when((F.col("left") == 0) & (F.col("state") == "DELETING"), "DROP_CHUNK").when(F.col("left") == 0, "KEEP_EMPTY").otherwise("SHRINK").alias("outcome"))


def owner_repairs(replicas: DataFrame, dead: DataFrame, owned: DataFrame, busy: DataFrame, rf: int) -> DataFrame:
    """Repairs by an owner, from the stored set of dead nodes: chunks of its namespaces that are not in repair already, with a
    dead member to swap or short of members. As live count only one dead member is taken off."""
    at = replicas.join(F.broadcast(dead.select("node_id").distinct().withColumn("dead", F.lit(True))), "node_id", "left").join(owned.select("namespace").distinct(), "namespace", "left_semi")
    per = at.groupBy(*CHUNK).agg(F.count("*").alias("members"), F.min(F.when(F.col("dead"), F.col("node_id"))).alias("dead_node"), F.min(F.when(F.col("dead").isNull(), F.col("node_id"))).alias("source_node"))
    per = per.withColumn("live", F.col("members") - F.when(F.col("dead_node").isNotNull(), 1).otherwise(0))
    todo = per.filter(F.col("source_node").isNotNull() & (F.col("dead_node").isNotNull() | (F.col("members") < rf)))
    return todo.join(busy.select(*CHUNK).distinct(), CHUNK, "left_anti")


def fenced_manifests(manifests: DataFrame) -> DataFrame:
    """Each acquisition of a namespace raises its epoch; the latest holds it and fences the earlier ones."""
    w = W.partitionBy("namespace")
    return manifests.withColumn("holds", F.col("epoch") == F.max("epoch").over(w))


def compaction_due(log_bytes: DataFrame, threshold: int) -> DataFrame:
    """Namespaces whose open log has reached the threshold."""
    return log_bytes.filter(F.col("open_bytes") >= threshold)


def counters(rows: DataFrame, names: list[str]) -> DataFrame:
    """Sums of counters per namespace, and over all of them."""
    return rows.rollup("namespace").agg(*[F.sum(n).alias(n) for n in names]).withColumn("namespace", F.coalesce("namespace", F.lit("all")))
