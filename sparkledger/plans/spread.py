"""The same rows as the SELECTs of some bindings, by plans that spread over the cluster.

Everything of a file stays where its lines were shuffled to, once, by file_id: in partitions of bounded size, so that the
memory of a task does not grow with the tables.  Joins, windows and aggregates whose keys hold the file find it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of lineitem's files that one partition takes.
PARTITION_BYTES = 1 << 20
#: Ranges of file_id that prefix sums of a namespace are taken in.
RANGES = 128

_RECORD = "named_struct('step', {0}, 'idx', CAST({1} AS BIGINT), 'kind', '{2}', 'path', {3}, 'length', CAST({4} AS BIGINT), 'write_epoch', CAST({5} AS BIGINT), 'at_ms', CAST({6} AS BIGINT))"


def _record(step: int, idx, kind: str, path="CAST(NULL AS STRING)", length="NULL", epoch="NULL", at="NULL", when: str = "TRUE") -> str:
    return f"CASE WHEN {when} THEN {_RECORD.format(step, idx, kind, path, length, epoch, at)} END"


_GOING = "state IN ('DELETING', 'DELETED')"
#: Records that a file has once.
OF_FILE = "array_compact(array(" + ", ".join([
    _record(0, -1, "FileCreated", path="path", at="created_ms"),
    _record(3, -1, "WriterEpochAllocated", epoch="writer_epoch"),
    _record(3, 99, "ChunkSealed", length="5", epoch="1", when="file_id % 5 = 0"),
    _record(4, -1, "FileSealed", when="state <> 'OPEN'"),
    _record(5, -1, "FileDeleting", when=_GOING),
    _record(6, -1, "PathUnbound", path="path", when=_GOING),
    _record(7, -1, "FileDeleted", at="deleted_ms", when="state = 'DELETED'"),
    _record(8, -1, "TombstoneSwept", when="state = 'DELETED' AND file_id % 2 = 0"),
    _record(8, 0, "FileSealed", when="state = 'DELETED' AND file_id % 6 = 0"),
    _record(9, -1, "FileCreated", path="path || '/again'", at="created_ms + 7", when="state = 'DELETED' AND file_id % 4 = 0"),
]) + "))"
_SEALED = "NOT (state = 'OPEN' AND is_tail)"
#: Records that a chunk has.
OF_CHUNK = "array_compact(array(" + ", ".join([
    _record(1, "idx", "ChunkCreated", length="0", epoch="line_epoch"),
    _record(1, "idx", "ChunkSealed", length="line_length", epoch="line_epoch", when=f"{_SEALED} AND idx % 4 <> 3"),
    _record(2, "idx", "ChunkAborted", when="idx % 4 = 3"),
]) + "))"
#: How many these are for all chunks of a file; only an open tail lacks its second one.
N_OF_CHUNKS = "2 * n_lines - CASE WHEN state = 'OPEN' AND n_lines > 0 AND (n_lines - 1) % 4 <> 3 THEN 1 ELSE 0 END"


def partitions(b) -> int:
    """Partitions for a file's rows. Joins on more keys than the file are to find them there as well, which Spark does not look for by
    itself; the setting is read when the plan is made, so it stays."""
    b.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    size = int(b.lineitem._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(b.spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def lines(b) -> DataFrame:
    """Lines of each order as chunks of its file: one sort gives the index and the last one."""
    w = W.partitionBy("file_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    at = b.lineitem.select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.col("l_quantity").cast("bigint").alias("line_length"))
    at = at.repartition(partitions(b), "file_id").withColumns({"idx": (F.row_number().over(w) - 1).cast("bigint"), "is_tail": F.lead(F.lit(1)).over(w).isNull()})
    return at.select("file_id", "idx", "is_tail", "line_length", F.col("l_linenumber").cast("bigint").alias("line_epoch"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"))


def _chunk(state: Column) -> list[Column]:
    return ["namespace", "file_id", "idx", state.alias("state"), F.col("line_length").alias("length"), F.expr("(partkey * 2654435761) % 4294967296").alias("crc"), F.col("line_epoch").alias("write_epoch"), "suppkey", "partkey"]


def chunks(b) -> DataFrame:
    files = b.files.select("namespace", "file_id", "state").repartition(partitions(b), "file_id")
    return lines(b).join(files, "file_id").select(*_chunk(F.expr(f"CASE WHEN {_SEALED} THEN 'SEALED' ELSE 'OPEN' END")))


def _placed(b) -> DataFrame:
    """Chunks with the list of their nodes. A chunk is one line, so the copies that DISTINCT takes out of replicas are in its own
    row, or come of a file that is there repeatedly: its chunks are here once, with all their states."""
    nodes = b.supplier.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("m"))
    once = b.files.select("namespace", "file_id", (F.col("state") == "OPEN").alias("open")).repartition(partitions(b), "file_id").groupBy("namespace", "file_id").agg(F.max("open").alias("open"), F.min("open").alias("all_open"))
    states = F.expr("array_compact(array(CASE WHEN is_tail AND open THEN 'OPEN' END, CASE WHEN NOT (is_tail AND all_open) THEN 'SEALED' END))")
    at = lines(b).join(once, "file_id").select(*_chunk(states)).withColumnRenamed("state", "states").crossJoin(F.broadcast(nodes))
    return at.withColumn("nodes", F.expr("array_distinct(array(suppkey % n + m, (suppkey + 7) % n + m, (suppkey + 14) % n + m))"))


def replicas(b) -> DataFrame:
    at = _placed(b).withColumn("state", F.explode("states"))
    return at.select("namespace", "file_id", "idx", "state", "length", "crc", "write_epoch", "partkey", F.explode("nodes").alias("node_id"))


_EDIT = "named_struct('log_offset', {0}, 'kind', '{1}', 'node_id', CAST({2} AS BIGINT), 'to_node', CAST({3} AS BIGINT))"


def replica_log(b) -> DataFrame:
    """All records of a chunk from its own row: the SELECT reads the replicas six times."""
    made = f"flatten(transform(states, s -> transform(nodes, x -> {_EDIT.format(1, 'ChunkCreated', 'x', 'NULL')})))"
    sealed = f"transform(voted, x -> {_EDIT.format(2, 'ChunkSealed', 'x', 'NULL')})"
    single = [
        f"CASE WHEN last_voted IS NOT NULL AND partkey % 3 = 0 THEN {_EDIT.format(3, 'ReplicaSwapped', 'last_voted', '100000 + last_voted')} END",
        f"CASE WHEN last_voted IS NOT NULL AND partkey % 6 = 0 THEN {_EDIT.format(4, 'ReplicaDropped', '100000 + last_voted', 'NULL')} END",
        f"CASE WHEN partkey % 5 = 0 THEN {_EDIT.format(5, 'ReplicaAdded', '200000 + partkey % 7', 'NULL')} END",
        f"CASE WHEN partkey % 23 = 0 THEN {_EDIT.format(6, 'ChunkDeleted', 'NULL', 'NULL')} END",
    ]
    at = _placed(b).withColumn("voted", F.expr("filter(nodes, x -> array_contains(states, 'SEALED') AND (partkey + x) % 4 <> 0)")).withColumn("last_voted", F.array_max("voted"))
    records = F.explode(F.expr(f"concat({made}, {sealed}, array_compact(array({', '.join(single)})))")).alias("r")
    return at.select("namespace", "file_id", "idx", records).select("namespace", "file_id", "idx", "r.*")


def _range(of: Column, bounds: list[int], first: int = 0) -> Column:
    """How many bounds lie below, by bisection; after the last for null."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(of <= bounds[k], _range(of, bounds[:k], first)).otherwise(_range(of, bounds[k + 1 :], first + k + 1))


def log_bases(b) -> DataFrame:
    """Files with the number of log records in their namespace before their own.

    Prefix sums are taken within ranges of file_id, and over the few totals of these.
    """
    n = partitions(b)
    counted = b.lineitem.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("n_lines"))
    bounds = b.orders.agg(F.percentile_approx("o_orderkey", [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).first()[0] or []
    per = b.files.repartition(n, "file_id").join(counted.repartition(n, "file_id"), "file_id", "left").na.fill(0, ["n_lines"])
    per = per.withColumns({"n_records": F.expr(f"{N_OF_CHUNKS} + size({OF_FILE})"), "in_range": _range(F.col("file_id"), sorted(set(bounds)))})
    before = W.partitionBy("t_namespace").orderBy("t_range").rowsBetween(W.unboundedPreceding, -1)
    totals = per.groupBy(F.col("namespace").alias("t_namespace"), F.col("in_range").alias("t_range")).agg(F.sum("n_records").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = W.partitionBy("namespace", "in_range", "file_id")
    up_to = W.partitionBy("namespace", "in_range").orderBy(F.asc_nulls_last("file_id")).rangeBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("base", F.sum("n_records").over(up_to) - F.sum("n_records").over(own))
    at = per.join(F.broadcast(totals), F.col("namespace").eqNullSafe(F.col("t_namespace")) & (F.col("in_range") == F.col("t_range")))
    return at.select("namespace", "file_id", "path", "state", "created_ms", "deleted_ms", "writer_epoch", (F.col("base") + F.col("earlier")).alias("base"))


def meta_log(b) -> DataFrame:
    """A record's offset is its place in its file after the records of the files before, so no task sees a whole namespace."""
    at = log_bases(b).repartition(partitions(b), "file_id").join(lines(b), "file_id", "left")
    none = "filter(" + OF_FILE + ", x -> false)"
    records = F.expr(f"concat(CASE WHEN idx IS NULL OR idx = 0 THEN {OF_FILE} ELSE {none} END, CASE WHEN idx IS NOT NULL THEN {OF_CHUNK} ELSE {none} END)")
    at = at.select("namespace", "file_id", "base", F.explode(records).alias("r")).select("namespace", "file_id", "base", "r.*")
    place = F.row_number().over(W.partitionBy("namespace", "file_id").orderBy("step", "idx", "kind"))
    return at.select("namespace", (F.col("base") + place - 1).alias("log_offset"), "kind", "file_id", "idx", "path", "length", "write_epoch", "at_ms")


PLANS = {"chunks": chunks, "replicas": replicas, "replica_log": replica_log, "meta_log": meta_log}
