"""Durable offsets, visibility and reads of append-only chunks.

Keys are (namespace, file_id); every window partitions by them, so plans keep one hash partitioning from end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["namespace", "file_id"]


def quorum_offsets(acks: DataFrame, quorum: int) -> DataFrame:
    """Durable offset per file: the quorum-th highest of the offsets that replicas acknowledged (each replica's highest).

    Two-level aggregation: the first combines map-side, the second sees one row per replica. A file with fewer replicas
    than the quorum has offset 0.
    """
    ends = acks.groupBy(*KEY, "node_id").agg(F.max("end_offset").alias("acked"))
    ranked = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list("acked"), asc=False).alias("acked"), F.max("acked").alias("local_end"))
    return ranked.select(*KEY, F.coalesce(F.get("acked", F.lit(quorum - 1)), F.lit(0)).alias("durable_offset"), "local_end")


def with_base_offsets(rows: DataFrame, end: str = "end_offset", order: str = "seq") -> DataFrame:
    """Base offset of each entry: the end of the one before."""
    return rows.withColumn("base_offset", F.lag(end, 1, 0).over(W.partitionBy(*KEY).orderBy(order)))


def chunk_bases(chunks: DataFrame) -> DataFrame:
    """Base offset of each chunk in its file: exclusive prefix sum of lengths."""
    w = W.partitionBy(*KEY).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("base_offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def monotonic(rows: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Running maximum: an offset that never goes back."""
    return rows.withColumn(out, F.max(column).over(W.partitionBy(*KEY).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def visible(records: DataFrame, durable: DataFrame) -> DataFrame:
    """Records that readers of an open chunk see: those that end at or before min(local end, durable offset)."""
    return records.join(durable, KEY).filter(F.col("end_offset") <= F.least("local_end", "durable_offset"))


def covering(entries: DataFrame, low: int, high: int) -> DataFrame:
    """Entries that overlap the byte range [low, high)."""
    return with_base_offsets(entries).filter((F.col("end_offset") > low) & (F.col("base_offset") < high))


def locate(chunks: DataFrame, requests: DataFrame, max_bytes: int) -> DataFrame:
    """The chunk that holds each requested file offset and the bytes to read there, never across a chunk boundary.

    An equi-join on the file with the interval as residual condition, so no Cartesian product.
    """
    hit = requests.join(chunk_bases(chunks), KEY).filter((F.col("base_offset") <= F.col("offset")) & (F.col("offset") < F.col("base_offset") + F.col("length")))
    return hit.select(*KEY, "offset", "idx", (F.col("offset") - F.col("base_offset")).alias("chunk_offset"), F.least(F.lit(max_bytes).cast("bigint"), F.col("base_offset") + F.col("length") - F.col("offset")).alias("n_bytes"))


def overlap_coverage(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Bytes of each requested range that intact entries cover, and whether that is all of it."""
    at = with_base_offsets(entries)
    over = requests.join(at, KEY).filter((F.col("end_offset") > F.col("low")) & (F.col("base_offset") < F.col("high")) & F.col("entry_ok"))
    part = F.least("end_offset", "high") - F.greatest("base_offset", "low")
    return over.groupBy(*KEY, "low", "high").agg(F.sum(part).alias("covered")).withColumn("complete", F.col("covered") == F.col("high") - F.col("low"))


def completion_times(acks: DataFrame, quorum: int) -> DataFrame:
    """When each append became durable: the quorum-th smallest, over replicas, of the first acknowledgement of its end or a later one."""
    w = W.partitionBy(*KEY, "node_id").orderBy("end_offset").rowsBetween(0, W.unboundedFollowing)
    first = acks.withColumn("done", F.min("ack_ms").over(w))
    return first.groupBy(*KEY, "seq", "end_offset").agg(F.get(F.sort_array(F.collect_list("done")), F.lit(quorum - 1)).alias("durable_ms")).filter("durable_ms IS NOT NULL")


def chunk_rolls(records: DataFrame, max_bytes: int, max_records: int) -> DataFrame:
    """Chunk number of each record where a chunk rolls once it holds max_bytes or max_records.

    The threshold resets at each roll, which no window frame expresses; each file goes through one Arrow group. A file is
    bounded by design; of a record only its sequence and length are sent.
    """
    import pyarrow as pa

    def roll(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["seq"].to_pylist(), table["length"].to_pylist(), strict=True))
        chunk, size, count, out = 0, 0, 0, []
        for seq, length in rows:
            if size >= max_bytes or count >= max_records:
                chunk, size, count = chunk + 1, 0, 0
            out.append((seq, chunk, size))
            size, count = size + length, count + 1
        n = len(out)
        first = table.slice(0, 1)
        return pa.table({"namespace": [first["namespace"][0].as_py()] * n, "file_id": pa.array([first["file_id"][0].as_py()] * n, pa.int64()), "seq": pa.array([r[0] for r in out], pa.int64()), "chunk": pa.array([r[1] for r in out], pa.int64()), "chunk_offset": pa.array([r[2] for r in out], pa.int64())})

    return records.select(*KEY, "seq", "length").groupBy(*KEY).applyInArrow(roll, "namespace string, file_id bigint, seq bigint, chunk bigint, chunk_offset bigint")


def group_commits(appends: DataFrame, every: int) -> DataFrame:
    """Forces that cover appends: one force per ``every`` appends covers all that end at or before its target."""
    w = W.partitionBy(*KEY).orderBy("seq")
    batch = F.floor((F.col("seq") - 1) / every)
    marked = appends.withColumn("batch", batch.cast("bigint"))
    return marked.groupBy(*KEY, "batch").agg(F.max("end_offset").alias("target"), F.max("ts_ms").alias("force_ms"), F.count("*").alias("waiters")).withColumn("gap_ms", F.least(F.lit(50), F.greatest(F.lit(1), F.col("force_ms") - F.lag("force_ms", 1).over(W.partitionBy(*KEY).orderBy("batch")))))


def contiguity_violations(rows: DataFrame) -> DataFrame:
    """Entries that do not start where the one before ended."""
    return with_base_offsets(rows).filter(F.col("end_offset") - F.col("base_offset") != F.col("length"))
