"""Tables, scratch space and batch settings shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: A side is broadcast only if its rows, counted first, take no more than this.
BROADCAST_BYTES = 8 << 20
#: Rows of one Arrow batch; bounds a Python worker's memory by this many texts.
BATCH_ROWS = 256

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that Spark hands to a Python worker at once, and see that workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where none is named, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sparkledger-")
    return _LOCAL[app]


class Scratch:
    """Written tables that cut lineage: they outlive lost executors and are read again without recomputation.

    The shuffle files behind a table go with the plan that wrote it.  An operator drops a table when its last reader is
    written, and closes its scratch with the tables that its result still reads; the folder goes with the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later plan reads."""
        for t in tables:
            path = getattr(t, "scratch_path", None)
            if path in self.paths and path is not None:
                delete(self.spark, path)
                self.paths[self.paths.index(path)] = None

    def close(self, *keep: DataFrame) -> None:
        """Delete all tables but those that the result reads."""
        kept = {t.scratch_path for t in keep}
        for i, path in enumerate(self.paths):
            if path is not None and path not in kept:
                delete(self.spark, path)
                self.paths[i] = None


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Let Spark delete the shuffle files of each plan that ends in here at its end, not when the driver collects its garbage."""
    old = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, old)


def only(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids (distinct): by a broadcast hash set if n_ids rows are small, by a shuffle beyond that."""
    from pyspark.sql import functions as F

    side = ids.select(key)
    return df.join(F.broadcast(side) if n_ids * 16 <= BROADCAST_BYTES else side.hint("merge"), key, "left_semi")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in have:
            name = "_" + name
        out.append(name)
    return out
