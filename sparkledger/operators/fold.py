"""Current state folded from an ordered metadata log, relationally.

Every kind of record is a last-value rule within an incarnation, so the fold is window functions and grouped
aggregates over (namespace, file) and (namespace, file, chunk); no driver state, no sequential replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILE = ["namespace", "file_id"]
LIFE = {"FileCreated": "OPEN", "FileSealed": "SEALED", "FileDeleting": "DELETING", "FileDeleted": "DELETED", "TombstoneSwept": "SWEPT"}


def effective(log: DataFrame) -> DataFrame:
    """Records that do something: a creation, or one of a file that was created and not swept since.

    Adds ``life``, the creations up to the record, and ``changes``, the changes of the file's row up to it (an unbound path and
    a sweep change none; ``weight`` counts a record as several).  One window, so one sort, for all of it.
    """
    w = W.partitionBy(*FILE).orderBy("log_offset")
    mark = F.when(F.col("kind").isin("FileCreated", "TombstoneSwept"), F.col("kind"))
    at = log if "weight" in log.columns else log.withColumn("weight", F.lit(1))
    at = at.withColumn("_mark", F.last(mark, True).over(w.rowsBetween(W.unboundedPreceding, -1))).filter("kind = 'FileCreated' OR _mark = 'FileCreated'").drop("_mark")
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    return at.withColumns({
        "life": F.sum(F.when(F.col("kind") == "FileCreated", 1).otherwise(0)).over(up_to),
        "changes": F.sum(F.when(F.col("kind").isin("PathUnbound", "TombstoneSwept"), 0).otherwise(F.col("weight"))).over(up_to),
    })


def file_state(log: DataFrame) -> DataFrame:
    """Files as they are at the end of the log: state, writer epoch, path, tombstone time, version. Swept files are gone.

    A version counts the changes since the last sweep, without the creation that began it; a repeated creation counts on.
    """
    at = effective(log)
    state = F.create_map(*[F.lit(x) for kv in LIFE.items() for x in kv])
    # Of a record kind only its last row counts; max_by skips rows where the ordering is null.
    on = lambda cond: F.when(cond, F.col("log_offset"))
    per = at.groupBy(*FILE).agg(
        F.element_at(state, F.max_by("kind", on(F.col("kind").isin(*LIFE)))).alias("state"),
        F.max_by(F.struct("life", "write_epoch"), on(F.col("kind") == "WriterEpochAllocated")).alias("_epoch"),
        F.max("life").alias("_life"),
        F.max_by("path", on(F.col("kind") == "FileCreated")).alias("path"),
        F.max_by("at_ms", on(F.col("kind") == "FileDeleted")).alias("deleted_at_ms"),
        (F.max("changes") - F.coalesce(F.max(F.when(F.col("kind") == "TombstoneSwept", F.col("changes"))), F.lit(0)) - 1).alias("version"),
    )
    epoch = F.when(F.col("_epoch.life") == F.col("_life"), F.col("_epoch.write_epoch")).otherwise(0)
    return per.filter("state <> 'SWEPT'").select(*FILE, "state", epoch.alias("writer_epoch"), "path", F.when(F.col("state") == "DELETED", F.col("deleted_at_ms")).alias("deleted_at_ms"), "version")


def _last_life(log: DataFrame) -> DataFrame:
    """Records of the last life of files that are not swept."""
    every = W.partitionBy(*FILE)
    at = effective(log).withColumns({"_lives": F.max("life").over(every), "_swept": F.max(F.when(F.col("kind") == "TombstoneSwept", F.col("life"))).over(every)})
    return at.filter("life = _lives AND (_swept IS NULL OR _swept < _lives)").drop("_lives", "_swept")


def chunk_state(log: DataFrame) -> DataFrame:
    """Chunks of files that are not swept. A chunk begins with its creation and ends when it is aborted or deleted; what is
    said of a chunk that is not there does nothing."""
    w = W.partitionBy(*FILE, "idx").orderBy("log_offset").rowsBetween(W.unboundedPreceding, -1)
    at = _last_life(log).filter("kind LIKE 'Chunk%'")
    mark = F.when(F.col("kind") != "ChunkSealed", F.col("kind"))
    at = at.withColumn("_mark", F.last(mark, True).over(w)).filter("kind <> 'ChunkSealed' OR _mark = 'ChunkCreated'")
    per = at.groupBy(*FILE, "idx").agg(F.max_by("kind", "log_offset").alias("kind"), F.max_by("length", "log_offset").alias("length"), F.max_by("write_epoch", "log_offset").alias("write_epoch"))
    live = per.filter("kind IN ('ChunkCreated', 'ChunkSealed')")
    return live.select(*FILE, "idx", F.when(F.col("kind") == "ChunkSealed", "SEALED").otherwise("OPEN").alias("state"), "length", "write_epoch")


def replica_lists(log: DataFrame) -> DataFrame:
    """Replicas of each chunk from (file, idx, log_offset, kind, node_id, to_node): creation and seal give a whole list, a row
    for each member; swap, drop and add edit it. A node is in if the last record that names it since the last list says so."""
    key = [*FILE, "idx"]
    begun = F.max(F.when(F.col("kind").isin("ChunkCreated", "ChunkSealed", "ChunkAborted", "ChunkDeleted"), F.col("log_offset"))).over(W.partitionBy(*key))
    at = log.withColumn("_begun", begun).filter("log_offset >= _begun AND kind NOT IN ('ChunkAborted', 'ChunkDeleted')")
    out = F.col("kind").isin("ReplicaSwapped", "ReplicaDropped")
    named = at.select(*key, "log_offset", F.explode(F.array(F.struct(F.col("node_id").alias("node"), (~out).alias("there")), F.struct(F.col("to_node").alias("node"), F.lit(True).alias("there")))).alias("x")).select(*key, "log_offset", "x.*")
    per = named.filter("node IS NOT NULL").groupBy(*key, "node").agg(F.max_by("there", "log_offset").alias("there"))
    return per.groupBy(*key).agg(F.sort_array(F.expr("collect_list(CASE WHEN there THEN node END)")).alias("replicas"))


def as_records(snapshot: DataFrame) -> DataFrame:
    """A snapshot of files as the records that lead to it, before any of the log; the first one counts for its version."""
    made = lambda step, kind, path="NULL", epoch="NULL", at="NULL", weight="0L": f"named_struct('log_offset', {step - 4}L, 'kind', {kind}, 'path', {path}, 'write_epoch', {epoch}, 'at_ms', {at}, 'weight', {weight})"
    kind = "CASE state WHEN 'SEALED' THEN 'FileSealed' WHEN 'DELETING' THEN 'FileDeleting' ELSE 'FileDeleted' END"
    rows = f"array({made(0, repr('FileCreated'), path='path', weight='version + 1')}, {made(1, repr('WriterEpochAllocated'), epoch='writer_epoch')}, CASE WHEN state <> 'OPEN' THEN {made(2, kind, at='deleted_at_ms')} END)"
    return snapshot.select(*FILE, F.explode(F.expr(f"filter({rows}, x -> x IS NOT NULL)")).alias("r")).select(*FILE, "r.*")


def resume(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The state that the tail leads to from a snapshot: what folding the whole log gives."""
    columns = [*FILE, "log_offset", "kind", "path", "write_epoch", "at_ms", "weight"]
    return file_state(as_records(snapshot).select(columns).union(tail.withColumn("weight", F.lit(1).cast("bigint")).select(columns)))


def usable_snapshot(manifests: DataFrame, snapshots: DataFrame, segments: DataFrame) -> DataFrame:
    """The snapshot that each namespace recovers from: of the published generation if it is readable, else of the one before
    if the log between them has no gap; refused otherwise.

    manifests: namespace, generation; snapshots: namespace, generation, cut, readable; segments: namespace, first, last.
    """
    first = manifests.join(snapshots, ["namespace", "generation"], "left").select("namespace", "generation", F.coalesce("readable", F.lit(False)).alias("ok"), F.col("cut").alias("own_cut"))
    before = snapshots.filter("readable").select("namespace", (F.col("generation") + 1).alias("generation"), F.col("cut").alias("old_cut"))
    w = W.partitionBy("namespace").orderBy("first")
    gaps = segments.withColumn("_gap", F.col("first") - F.lag("last").over(w) > 1).groupBy("namespace").agg(F.max(F.coalesce("_gap", F.lit(False))).alias("gap"), F.min("first").alias("starts"))
    at = first.join(before, ["namespace", "generation"], "left").join(gaps, "namespace", "left")
    whole = ~F.coalesce("gap", F.lit(False)) & (F.coalesce(F.col("starts"), F.col("old_cut")) <= F.col("old_cut"))
    source = F.when(F.col("ok"), "CURRENT").when(F.col("old_cut").isNotNull() & whole, "PREVIOUS").otherwise("REFUSED")
    return at.select("namespace", "generation", source.alias("source"), F.when(source == "CURRENT", F.col("own_cut")).when(source == "PREVIOUS", F.col("old_cut")).alias("cut"))


def bindings(log: DataFrame) -> DataFrame:
    """Paths bound to files: the last creation at a path, unless the same file was unbound from it later."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("log_offset")))
    per = log.filter("kind IN ('FileCreated', 'PathUnbound')").groupBy("namespace", "path", "file_id").agg(at("FileCreated").alias("bound_at"), at("PathUnbound").alias("unbound_at"))
    last = per.groupBy("namespace", "path").agg(F.max_by("file_id", "bound_at").alias("file_id"), F.max_by("unbound_at", "bound_at").alias("unbound_at"), F.max("bound_at").alias("bound_at"))
    return last.filter("bound_at IS NOT NULL AND (file_id IS NULL OR unbound_at IS NULL OR unbound_at < bound_at)").select("namespace", "path", "file_id")


def high_water(log: DataFrame) -> DataFrame:
    """Next file id of each namespace; sweeping does not lower it."""
    return log.filter("kind = 'FileCreated'").groupBy("namespace").agg((F.max("file_id") + 1).alias("next_file_id"))


def assign_ids(requests: DataFrame, next_ids: DataFrame, order: str) -> DataFrame:
    """Ids for new rows of each namespace from its high-water mark on."""
    at = requests.join(next_ids, "namespace", "left")
    return at.withColumn("new_id", F.coalesce("next_file_id", F.lit(0)) + F.row_number().over(W.partitionBy("namespace").orderBy(order)) - 1)


def snapshot_tail(log: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """State at a cut and the records from it on; folding both equals folding the whole log."""
    return file_state(log.filter(F.col("log_offset") < cut)), log.filter(F.col("log_offset") >= cut)


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Log records that lead from old to new chunk lists of (namespace, file_id, idx, state, replicas)."""
    key = [*FILE, "idx"]
    o = old.select(*key, F.col("state").alias("o_state"), F.col("replicas").alias("o_replicas"))
    n = new.select(*key, F.col("state").alias("n_state"), F.col("replicas").alias("n_replicas"))
    at = o.join(n, key, "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("o_state").isNull(), "ChunkCreated"),
        F.when(F.col("n_state").isNull(), "ChunkDeleted"),
        F.when((F.col("n_state") == "SEALED") & (F.coalesce("o_state", F.lit("OPEN")) != "SEALED"), "ChunkSealed"),
    ))
    both = (F.col("o_state") == "SEALED") & (F.col("n_state") == "SEALED")
    gone = F.when(both, F.array_except("o_replicas", "n_replicas")).otherwise(F.array().cast("array<bigint>"))
    more = F.when(both, F.array_except("n_replicas", "o_replicas")).otherwise(F.array().cast("array<bigint>"))
    at = at.select(*key, kinds.alias("kinds"), F.coalesce(gone, F.array().cast("array<bigint>")).alias("dropped"), F.coalesce(more, F.array().cast("array<bigint>")).alias("added"))
    one = "named_struct('kind', {0}, 'node_id', {1})"
    records = f"concat(transform(kinds, k -> {one.format('k', 'CAST(NULL AS BIGINT)')}), transform(dropped, n -> {one.format(repr('ReplicaDropped'), 'n')}), transform(added, n -> {one.format(repr('ReplicaAdded'), 'n')}))"
    return at.select(*key, F.explode(F.expr(records)).alias("r")).select(*key, "r.kind", "r.node_id")


def seal_file_check(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether a file may be sealed at a total length: all chunks sealed and their lengths add up to it."""
    per = chunks.groupBy(*FILE).agg(F.every(F.col("state") == "SEALED").alias("all_sealed"), F.sum("length").alias("length"))
    return per.join(totals, FILE).select(*FILE, "length", (F.col("all_sealed") & (F.col("length") == F.col("total"))).alias("may_seal"))


def seal_chunk(requests: DataFrame, quorum: int) -> DataFrame:
    """Replicas kept when a chunk is sealed: those of the descriptor that sealed it; rejected below the quorum.

    requests: namespace, file_id, idx, replicas, sealed (arrays).
    """
    kept = F.array_intersect("replicas", "sealed")
    return requests.select(*FILE, "idx", F.size(kept).cast("bigint").alias("n_kept"), (F.size(kept) >= quorum).alias("accepted"))


def create_files(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Outcome of creation requests: EXISTS for an operation done before with the same path, CONFLICT for a path in use, DELETED
    for an operation whose file is gone, else CREATED. requests: namespace, path, op; live: namespace, path, op, state."""
    by_op = live.select("namespace", "op", F.col("path").alias("op_path"), F.col("state").alias("op_state"))
    by_path = live.filter("state IN ('OPEN', 'SEALED')").select("namespace", "path").distinct().withColumn("used", F.lit(True))
    at = requests.join(by_op, ["namespace", "op"], "left").join(by_path, ["namespace", "path"], "left")
    outcome = F.when(F.col("op_state") == "DELETED", "DELETED").when(F.col("op_path") == F.col("path"), "EXISTS").when(F.col("op_path").isNotNull() | F.col("used"), "CONFLICT").otherwise("CREATED")
    return at.select("namespace", "path", "op", outcome.alias("outcome"))
