"""Sources and sinks: directory walks, snapshots with a manifest, metric exposition text."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_FILE = r"/([A-Za-z0-9._-]+)/([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{16})\.(\d+)$"
EXPOSITION = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$'


def walk_chunks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Chunk files under namespace/L1/L2 (without their content), and stray files for quarantine."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    part = lambda i: F.regexp_extract("path", CHUNK_FILE, i)
    at = found.withColumn("ok", F.col("path").rlike(CHUNK_FILE))
    chunks = at.filter("ok").select(part(1).alias("namespace"), F.conv(part(4), 16, -10).cast("bigint").alias("file_id"), part(5).cast("int").alias("idx"), "length", "path")
    return chunks, at.filter("NOT ok").select("path", "length")


def _paths(spark: SparkSession, root: str):
    """The file system of a folder, and a function from names to paths in it."""
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{x}" if x else root)
    return path("").getFileSystem(spark._jsc.hadoopConfiguration()), path


def snapshot_version(spark: SparkSession, root: str) -> int:
    """The version of the published snapshot; 0 before the first."""
    fs, path = _paths(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(path(""))] if fs.exists(path("")) else []
    return max([int(n.removeprefix("manifest-")) for n in names if re.fullmatch(r"manifest-\d{12}", n)], default=0)


def write_snapshot(state: DataFrame, root: str, cut: int, expected: int | None = None) -> int:
    """Write a state as of a log cut and publish it as the version after ``expected`` (the current one if not given).

    Each version is a manifest file of its own that is created exclusively, once its snapshot is complete: of two writers that
    expect the same version one fails with FileExistsError and deletes nothing of the other's, and readers always find one.
    """
    spark = state.sparkSession
    if expected is None:
        expected = snapshot_version(spark, root)
    name = f"snapshot-{cut}-{uuid.uuid4().hex[:8]}"
    state.write.parquet(f"{root}/{name}")
    fs, path = _paths(spark, root)
    try:
        out = fs.create(path(f"manifest-{expected + 1:012d}"), False)
    except Exception as e:
        fs.delete(path(name), True)
        raise FileExistsError(f"version {expected + 1} was published meanwhile") from e
    out.write(f"{name}\n{cut}\n".encode())
    out.close()
    return expected + 1


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The current snapshot and its cut; records at or after the cut are still to be folded. A manifest that is not written to
    its end does not count, and a snapshot that fails to read is tried once more."""
    for version in range(snapshot_version(spark, root), 0, -1):
        lines = [r[0] for r in spark.read.text(f"{root}/manifest-{version:012d}", wholetext=True).collect()]
        if lines and lines[0].count("\n") == 2:
            name, cut = lines[0].split()
            try:
                return spark.read.parquet(f"{root}/{name}"), int(cut)
            except AnalysisException:
                return spark.read.parquet(f"{root}/{name}"), int(cut)
    raise FileNotFoundError(f"no snapshot in {root}")


def parse_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metric, labels and value of exposition lines; comments and malformed lines are left out."""
    part = lambda i: F.regexp_extract(column, EXPOSITION, i)
    pairs = F.expr(f"""regexp_extract_all(regexp_extract({column}, r'{EXPOSITION}', 2), '([a-zA-Z_][a-zA-Z0-9_]*)="', 1)""")
    values = F.expr(f"""regexp_extract_all(regexp_extract({column}, r'{EXPOSITION}', 2), '="([^"]*)"', 1)""")
    return lines.filter(F.col(column).rlike(EXPOSITION)).select(part(1).alias("metric"), F.map_from_arrays(pairs, values).alias("labels"), part(3).try_cast("double").alias("sample")).filter("sample IS NOT NULL")


def append_log(records: DataFrame, path: str) -> None:
    """Append records to a log table, partitioned by namespace."""
    records.write.mode("append").partitionBy("namespace").parquet(path)
