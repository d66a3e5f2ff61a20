"""Structured Streaming forms of the stateful operators; on the same input they end with the batch results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

DECISIONS = "namespace string, file_id bigint, event_id bigint, accepted boolean, reason string, end_offset bigint"

#: State of a bucket: its files, with the end and the fence of each.
HELD = "namespaces array<string>, file_ids array<string>, ends array<bigint>, fences array<bigint>"
#: Files share so many calls of the state machine, as a call for each file costs more than its rows; a checkpoint depends on it.
BUCKETS = 256


def _folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkledger-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of append requests: a length, the writer's epoch, and fences."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    return raw.selectExpr("event_type AS namespace", "user_id AS file_id", "event_id", "CAST(length(props) AS BIGINT) AS length", "1 + event_id DIV 4000 AS epoch", "event_id % 29 = 0 AS fence", "ts", "value")


def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per file: fencing comes first, an accepted append moves the end; rows of a trigger are taken in order, so the requests,
    which carry lengths and no base, are contiguous by themselves. The files of a bucket are decided at once."""
    held = {(n, f): (end, fence) for n, f, end, fence in zip(*state.get, strict=True)} if state.exists else {}
    rows = pd.concat(list(batches), ignore_index=True).sort_values("event_id", kind="stable", ignore_index=True)
    file = rows.groupby(["namespace", "file_id"], dropna=False, sort=False).ngroup()
    names = rows[["namespace", "file_id"]][~file.duplicated()].astype(object)
    names = [tuple(None if pd.isna(x) else x for x in r) for r in names.itertuples(index=False)]
    ends, fences = (np.array([held.get(n, (0, 0))[k] for n in names], dtype="int64") for k in (0, 1))
    raised = (rows["epoch"] + 1).where(rows["fence"], 0).groupby(file).cummax()
    before = np.maximum(raised.groupby(file).shift(1, fill_value=0), fences[file])
    ok = rows["epoch"] >= before
    end = rows["length"].where(ok, 0).fillna(0).astype("int64").groupby(file).cumsum() + ends[file]
    last = ~file.duplicated(keep="last")
    ends[file[last]], fences[file[last]] = end[last], np.maximum(raised, fences[file])[last]
    held |= {n: (int(e), int(f)) for n, e, f in zip(names, ends, fences, strict=True)}
    state.update(([n for n, _ in held], [f for _, f in held], [e for e, _ in held.values()], [f for _, f in held.values()]))
    yield pd.DataFrame({"namespace": rows["namespace"], "file_id": rows["file_id"], "event_id": rows["event_id"], "accepted": ok, "reason": np.where(ok, "OK", "FENCED_EPOCH"), "end_offset": end})


def finish(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and read its result from the shared folder."""
    spark = stream.sparkSession
    folder = _folder(spark)
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def append_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    # Names as text, which pandas keeps as it is beside nulls.
    rows = appends(spark, sf_dir).selectExpr("CAST(namespace AS STRING) AS namespace", "CAST(file_id AS STRING) AS file_id", "event_id", "length", "epoch", "fence", f"pmod(hash(namespace, file_id), {BUCKETS}) AS bucket")
    out = finish(rows.groupBy("bucket").applyInPandasWithState(decide, DECISIONS.replace("file_id bigint", "file_id string"), HELD, "append", GroupStateTimeout.NoTimeout), "append")
    return out.withColumn("file_id", F.col("file_id").cast("bigint"))


def latest_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest heartbeat of each node."""
    beats = appends(spark, sf_dir).selectExpr("file_id AS node_id", "event_id * 250 AS ts_ms", "CAST(floor(value) AS BIGINT) AS free_bytes")
    return finish(beats.groupBy("node_id").agg(F.max("ts_ms").alias("ts_ms"), F.max_by("free_bytes", "ts_ms").alias("free_bytes")), "complete")


def first_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations without their retries: one row per operation id, kept as long as the watermark allows."""
    ops = appends(spark, sf_dir).select("namespace", F.col("file_id").alias("op"), F.col("ts").cast("timestamp").alias("at"))
    return finish(ops.withWatermark("at", "3650 days").dropDuplicates(["namespace", "op"]).select("namespace", "op"), "append")


def windowed_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended bytes of each hour by namespace."""
    at = appends(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    per = at.groupBy(F.window("at", "1 hour"), "namespace").agg(F.sum("length").alias("bytes"), F.count("*").alias("ops"))
    return finish(per.select("namespace", (F.unix_seconds("window.start") / 3600).cast("bigint").alias("hour"), "bytes", "ops"), "complete")
