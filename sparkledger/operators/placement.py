"""Ownership by rendezvous hashing and placement of replicas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship


def score(namespace: Column, generation: int, endpoint: Column) -> Column:
    """First eight bytes of SHA-256 over namespace, 0, generation (big-endian 32 bits), 0, endpoint, as a signed number."""
    zero = F.unhex(F.lit("00"))
    message = F.concat(F.encode(namespace, "UTF-8"), zero, F.unhex(F.lit(f"{generation & 0xFFFFFFFF:08x}")), zero, F.encode(endpoint, "UTF-8"))
    return F.conv(F.substring(F.sha2(message, 256), 1, 16), 16, -10).cast("bigint")


def owners(namespaces: DataFrame, endpoints: DataFrame, generation: int, count: int) -> DataFrame:
    """The endpoints that own each namespace, by score; as many as asked for, at least one, at most all.

    Endpoints are a cluster's membership and broadcast only if Spark finds them small; the ranking keeps the best rows of
    each task before the shuffle.
    """
    ends = endpoints.select("endpoint").distinct()
    scored = namespaces.select("namespace").distinct().crossJoin(ends).withColumn("score", score(F.col("namespace"), generation, F.col("endpoint")))
    w = W.partitionBy("namespace").orderBy(F.desc("score"), "endpoint")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, count)).select("namespace", "endpoint", F.col("rank").cast("bigint").alias("rank"))


def eligible(nodes: DataFrame, now: int, grace: int) -> DataFrame:
    """Nodes that may take replicas: registered, lease and grace not over, space left."""
    return nodes.filter((F.col("state") == "REGISTERED") & (F.try_add("lease_until_ms", F.lit(grace)) >= now) & (F.col("free_bytes") > 0))


def without(nodes: DataFrame, excluded: DataFrame, hosts: DataFrame) -> DataFrame:
    """Nodes that are neither excluded themselves nor on an excluded host."""
    return nodes.join(excluded.select("node_id").distinct(), "node_id", "left_anti").join(hosts.select("host").distinct(), "host", "left_anti")


def place(requests: DataFrame, nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """Weighted choice without replacement of ``count`` nodes on distinct hosts for each request.

    One node after the other is drawn by its free bytes among those on hosts that are not taken yet; the draws come from a
    seeded hash, so the choice is repeatable. A request with too few hosts gets none. Nodes are a cluster's membership and go
    to every worker, ordered by host: a taken host is then one interval of the running weights, which a draw steps over, so
    that a request costs ``count`` binary searches whatever the number of nodes.
    """
    spark = requests.sparkSession
    ship(spark)
    members = nodes.select("node_id", "host", F.greatest(F.lit(1).cast("bigint"), F.col("free_bytes")).alias("weight")).orderBy("host", "node_id", "weight").toArrow()
    ring = spark.sparkContext.broadcast(Ring(members))
    draws = [F.shiftrightunsigned(F.xxhash64("request", F.lit(k), F.lit(seed)), 1).alias(f"draw_{k}") for k in range(count)]
    types = dict(nodes.select("node_id", "host").dtypes)
    schema = f"request {dict(requests.dtypes)['request']}, node_id {types['node_id']}, host {types['host']}, rank bigint"
    return requests.select("request").distinct().select("request", *draws).mapInArrow(lambda batches: (ring.value.placed(x) for x in batches), schema)


class Ring:
    """Nodes (node_id, host, weight), ordered by host, as intervals of whole numbers."""

    def __init__(self, members: pa.Table):
        self.node_ids, self.hosts = (members[c].combine_chunks() for c in ("node_id", "host"))
        weights, names = members["weight"].to_pylist(), self.hosts.to_pylist()
        self.total = sum(weights)
        # Floats draw evenly below 2**53 only, and sums could leave 64 bits; beyond that Python's own integers do both.
        self.exact = self.total < 1 << 53
        ends = np.cumsum(np.array(weights, dtype=np.int64 if self.exact else object))
        first = np.array([i for i in range(len(names)) if not i or names[i] != names[i - 1]], dtype=np.int64)
        self.ends, self.n_hosts = ends, len(first)
        self.host_of = np.repeat(np.arange(len(first)), np.diff([*first.tolist(), len(names)]))
        self.host_start = (ends - np.array(weights, dtype=ends.dtype))[first]
        self.host_size = np.diff(np.append(self.host_start, ends[-1:]))

    def choose(self, draws: list[np.ndarray]) -> np.ndarray:
        """Positions of the nodes that draws of 63 bits choose, a column for each."""
        n = len(draws[0])
        taken = np.zeros((n, 0), dtype=np.int64)
        out = []
        for draw in draws:
            left = self.total - self.host_size[taken].sum(axis=1)
            if self.exact:
                at = np.minimum(((draw >> 10) * 2.0**-53 * left).astype(np.int64), left - 1)
            else:
                at = draw.astype(object) * left // (1 << 63)
            for host in taken.T:
                at = at + np.where(at >= self.host_start[host], self.host_size[host], 0)
            node = np.searchsorted(self.ends, at, side="right")
            out.append(node)
            # By place, so that steps over several hosts are taken from left to right.
            taken = np.sort(np.column_stack([taken, self.host_of[node]]), axis=1)
        return np.column_stack(out)

    def placed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        count = batch.num_columns - 1
        some = 0 < count <= self.n_hosts and batch.num_rows > 0
        nodes = self.choose([batch.column(k + 1).to_numpy() for k in range(count)]).ravel() if some else np.zeros(0, dtype=np.int64)
        rows = np.repeat(np.arange(batch.num_rows), count) if some else nodes
        ranks = np.tile(np.arange(1, count + 1), batch.num_rows) if some else nodes
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), self.node_ids.take(pa.array(nodes)), self.hosts.take(pa.array(nodes)), pa.array(ranks)], names=["request", "node_id", "host", "rank"])


def first_per_key(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key in an order: a queue with a limit."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= most)


def round_robin(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """Rows dealt to n slots in turn, within each key."""
    return rows.withColumn("slot", F.pmod(F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1, F.lit(n)).cast("bigint"))
