"""Binding of the star-schema tables to the domain tables of the log engine.

Each binding is one portable SELECT, so that Spark and the SQL oracle see the same domain rows; operators never share
code with their oracle.  Where the SELECT would bring a namespace into one task or shuffle a file's rows again and again,
Spark has its own plan for the same rows, in ``spread``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spread import PLANS

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: name -> (tables it reads, SELECT)
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "records": (
        ("events",),
        """SELECT event_type AS namespace, user_id AS file_id, event_id, event_id * 250 AS ts_ms, value,
             CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) AS seq,
             CAST(length(props) AS BIGINT) AS length,
             CAST(sum(length(props)) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_offset,
             props AS payload, 1 + CAST(floor(event_id / 4000) AS BIGINT) AS write_epoch FROM {events}""",
    ),
    "acks": (
        ("records",),
        """SELECT r.namespace, r.file_id, r.event_id, r.seq, r.end_offset, n.node_id, r.ts_ms, r.ts_ms + (r.event_id * (n.node_id + 7) * 31) % 97 AS ack_ms
           FROM {records} r CROSS JOIN (SELECT 0 AS node_id UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE (r.event_id + n.node_id) % 11 <> 0""",
    ),
    "files": (
        ("orders",),
        """SELECT 'ns' || CAST(o_custkey % 5 AS VARCHAR(4)) AS namespace, o_orderkey AS file_id, '/orders/' || CAST(o_orderkey AS VARCHAR(20)) AS path,
             CASE o_orderstatus WHEN 'F' THEN 'SEALED' WHEN 'O' THEN 'OPEN' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'DELETED' ELSE 'DELETING' END END AS state,
             3 AS replication_factor, 2 AS ack_quorum, o_orderkey * 100 AS created_ms, o_orderkey * 100 + 50000 AS deleted_ms, 1 + o_custkey % 4 AS writer_epoch FROM {orders}""",
    ),
    "chunks": (
        ("lineitem", "files"),
        """SELECT f.namespace, c.file_id, c.idx, CASE WHEN f.state = 'OPEN' AND c.last_one = 1 THEN 'OPEN' ELSE 'SEALED' END AS state, c.length, c.crc, c.write_epoch, c.suppkey, c.partkey
           FROM (SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS idx,
                   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS BIGINT) AS last_one,
                   CAST(l_quantity AS BIGINT) AS length, (l_partkey * 2654435761) % 4294967296 AS crc, CAST(l_linenumber AS BIGINT) AS write_epoch, l_suppkey AS suppkey, l_partkey AS partkey FROM {lineitem}) c
           JOIN {files} f ON f.file_id = c.file_id""",
    ),
    "nodes": (
        ("supplier", "nation"),
        """SELECT s_suppkey AS node_id, 'h' || CAST(s_nationkey AS VARCHAR(4)) AS host, n_regionkey AS zone, 'node' || CAST(s_suppkey AS VARCHAR(10)) || ':9301' AS endpoint,
             CAST(floor(s_acctbal) AS BIGINT) AS free_bytes, 10000 AS capacity_bytes, s_suppkey * 100 AS lease_until_ms,
             CASE WHEN s_suppkey % 7 = 0 THEN 'DEAD' WHEN s_suppkey % 11 = 0 THEN 'DRAINING' ELSE 'REGISTERED' END AS state FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    ),
    "replicas": (
        ("chunks", "supplier"),
        """SELECT DISTINCT namespace, file_id, idx, state, length, crc, write_epoch, partkey, (suppkey + k * 7) % n + m AS node_id
           FROM {chunks} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks CROSS JOIN (SELECT count(*) AS n, min(s_suppkey) AS m FROM {supplier}) s""",
    ),
    "reports": (
        ("replicas",),
        """SELECT namespace, file_id, idx, node_id, CASE WHEN (partkey + node_id) % 19 = 0 THEN 'OPEN' ELSE 'SEALED' END AS state,
             length - CASE WHEN (partkey + node_id) % 23 = 0 THEN 1 ELSE 0 END AS length, crc + CASE WHEN (partkey * 3 + node_id) % 29 = 0 THEN 1 ELSE 0 END AS crc
           FROM {replicas} WHERE (partkey + node_id) % 17 <> 0""",
    ),
    "votes": (
        ("reports",),
        """SELECT namespace, file_id, idx, node_id, length AS final_length, crc, CAST(row_number() OVER (PARTITION BY namespace, file_id, idx ORDER BY node_id) AS BIGINT) AS vote_seq FROM {reports}""",
    ),
    "entries": (
        ("records",),
        """SELECT namespace, file_id, seq, end_offset, event_id % 41 <> 0 AS payload_ok, event_id % 53 <> 0 AS entry_ok, event_id % 97 <> 0 AS data_present FROM {records}""",
    ),
    "meta_log": (
        ("chunks", "files"),
        """SELECT namespace, CAST(row_number() OVER (PARTITION BY namespace ORDER BY file_id, step, idx, kind) - 1 AS BIGINT) AS log_offset, kind, file_id, idx, path, length, write_epoch, at_ms FROM (
             SELECT namespace, file_id, 0 AS step, CAST(-1 AS BIGINT) AS idx, 'FileCreated' AS kind, path, CAST(NULL AS BIGINT) AS length, CAST(NULL AS BIGINT) AS write_epoch, created_ms AS at_ms FROM {files}
             UNION ALL SELECT namespace, file_id, 1, idx, 'ChunkCreated', NULL, 0, write_epoch, NULL FROM {chunks}
             UNION ALL SELECT namespace, file_id, 1, idx, 'ChunkSealed', NULL, length, write_epoch, NULL FROM {chunks} WHERE state = 'SEALED' AND idx % 4 <> 3
             UNION ALL SELECT namespace, file_id, 2, idx, 'ChunkAborted', NULL, NULL, NULL, NULL FROM {chunks} WHERE idx % 4 = 3
             UNION ALL SELECT namespace, file_id, 3, -1, 'WriterEpochAllocated', NULL, NULL, writer_epoch, NULL FROM {files}
             UNION ALL SELECT namespace, file_id, 4, -1, 'FileSealed', NULL, NULL, NULL, NULL FROM {files} WHERE state <> 'OPEN'
             UNION ALL SELECT namespace, file_id, 5, -1, 'FileDeleting', NULL, NULL, NULL, NULL FROM {files} WHERE state IN ('DELETING', 'DELETED')
             UNION ALL SELECT namespace, file_id, 6, -1, 'PathUnbound', path, NULL, NULL, NULL FROM {files} WHERE state IN ('DELETING', 'DELETED')
             UNION ALL SELECT namespace, file_id, 7, -1, 'FileDeleted', NULL, NULL, NULL, deleted_ms FROM {files} WHERE state = 'DELETED'
             UNION ALL SELECT namespace, file_id, 8, -1, 'TombstoneSwept', NULL, NULL, NULL, NULL FROM {files} WHERE state = 'DELETED' AND file_id % 2 = 0
             UNION ALL SELECT namespace, file_id, 8, 0, 'FileSealed', NULL, NULL, NULL, NULL FROM {files} WHERE state = 'DELETED' AND file_id % 6 = 0
             UNION ALL SELECT namespace, file_id, 3, 99, 'ChunkSealed', NULL, 5, 1, NULL FROM {files} WHERE file_id % 5 = 0
             UNION ALL SELECT namespace, file_id, 9, -1, 'FileCreated', path || '/again', NULL, NULL, created_ms + 7 FROM {files} WHERE state = 'DELETED' AND file_id % 4 = 0) e""",
    ),
    "replica_log": (
        ("replicas",),
        """SELECT namespace, file_id, idx, 1 AS log_offset, 'ChunkCreated' AS kind, node_id, CAST(NULL AS BIGINT) AS to_node FROM {replicas}
           UNION ALL SELECT namespace, file_id, idx, 2, 'ChunkSealed', node_id, NULL FROM {replicas} WHERE state = 'SEALED' AND (partkey + node_id) % 4 <> 0
           UNION ALL SELECT namespace, file_id, idx, 3, 'ReplicaSwapped', max(node_id), 100000 + max(node_id) FROM {replicas} WHERE state = 'SEALED' AND partkey % 3 = 0 AND (partkey + node_id) % 4 <> 0 GROUP BY namespace, file_id, idx
           UNION ALL SELECT namespace, file_id, idx, 4, 'ReplicaDropped', 100000 + max(node_id), NULL FROM {replicas} WHERE state = 'SEALED' AND partkey % 6 = 0 AND (partkey + node_id) % 4 <> 0 GROUP BY namespace, file_id, idx
           UNION ALL SELECT DISTINCT namespace, file_id, idx, 5, 'ReplicaAdded', 200000 + partkey % 7, CAST(NULL AS BIGINT) FROM {replicas} WHERE partkey % 5 = 0
           UNION ALL SELECT DISTINCT namespace, file_id, idx, 6, 'ChunkDeleted', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {replicas} WHERE partkey % 23 = 0""",
    ),
    "replica_states": (
        ("replicas",),
        """SELECT namespace, file_id, idx, node_id, CASE (partkey + node_id) % 5 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'DELETING' ELSE 'SEALED' END AS state, length AS local_end,
             length - (partkey * 3 + node_id) % 4 - CASE WHEN (partkey + node_id) % 31 = 0 THEN 100 ELSE 0 END AS last_known_do, write_epoch, write_epoch + node_id % 2 AS fence_epoch, length - partkey % 2 AS sealed_length,
             length - (partkey + 2 * node_id) % 9 AS flushed, write_epoch + (partkey + node_id) % 3 AS ask_epoch, length - node_id % 3 AS ask_length, partkey FROM {replicas}""",
    ),
    "aborts": (
        ("chunks",),
        """SELECT namespace, file_id, idx + CASE WHEN partkey % 8 = 0 THEN 50 ELSE 0 END AS idx, write_epoch + partkey % 3 - 1 AS write_epoch, suppkey + CASE WHEN partkey % 5 = 0 THEN 1 ELSE 0 END AS op FROM {chunks}""",
    ),
    "registrations": (
        ("nodes",),
        """SELECT CASE WHEN node_id % 10 = 3 THEN -node_id ELSE node_id END AS node_id, node_id + CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END AS incarnation, CASE WHEN node_id % 13 = 1 THEN 'noport' ELSE endpoint END AS endpoint,
             'z' || CAST(zone AS VARCHAR(4)) AS zone, CASE WHEN node_id % 17 = 2 THEN ' ' ELSE 'r1' END AS rack, host, CASE WHEN node_id % 19 = 4 THEN 0 ELSE 10000 END AS capacity_bytes FROM {nodes}""",
    ),
    "completions": (
        ("events",),
        """SELECT event_id % 3000 AS command_id, user_id % 8 AS node_id, 1 + event_id % 2 AS session_epoch, event_id % 3 AS status, event_id * 250 AS at_ms FROM {events}""",
    ),
    "inflight": (
        ("events",),
        """SELECT event_id * 2 AS command_id, user_id % 8 AS executing_node FROM {events}""",
    ),
    "responses": (
        ("events",),
        """SELECT user_id * 100 + event_id % 20 AS request, event_id AS attempt, event_id % 3 AS node_id, event_id % 4 <> 0 AS ok, event_id % 2 = 0 AS sealed, event_id % 50 AS at_offset, 16 AS want,
             event_id % 19 AS got, 60 AS end_at, CASE WHEN event_id % 11 = 0 THEN 61 ELSE 40 + event_id % 20 END AS durable FROM {events}""",
    ),
    "holdings": (
        ("replicas",),
        """SELECT namespace, file_id, idx, node_id, length - node_id % 2 AS end_at, length - 1 AS to_offset, CASE WHEN (partkey + node_id) % 13 = 0 THEN NULL WHEN (partkey + node_id) % 7 < 2 THEN 'x' || CAST(node_id % 2 AS VARCHAR(4)) ELSE 'good' END AS digest FROM {replicas}""",
    ),
    "images": (
        ("replicas",),
        """SELECT namespace, file_id, idx, node_id, file_id AS chunk_id, file_id + CASE WHEN (partkey + node_id) % 11 = 0 THEN 1 ELSE 0 END AS header_id, length, length - CASE WHEN (partkey + node_id) % 13 = 0 THEN 1 ELSE 0 END AS trailer_length, crc,
             crc + CASE WHEN (partkey + node_id) % 17 = 0 THEN 1 ELSE 0 END AS data_crc, crc + CASE WHEN (partkey + node_id) % 19 = 0 THEN 1 ELSE 0 END AS trailer_crc, 64 AS header_size, 64 + length + CASE WHEN (partkey + node_id) % 23 = 0 THEN 1 ELSE 0 END AS footer_start,
             64 + length + CASE WHEN (partkey + node_id) % 46 = 0 THEN 0 ELSE 8 END AS trailer_offset, 7 AS footer_crc, 7 + CASE WHEN (partkey + node_id) % 29 = 0 THEN 1 ELSE 0 END AS trailer_footer_crc FROM {replicas}""",
    ),
    "probes": (
        ("replicas",),
        """SELECT namespace, file_id, idx, node_id, partkey % 3 = 0 AS trailer_ok, node_id % 2 = 0 AS trailer_like, partkey % 4 > 1 AS has_sidecar, partkey % 5 > 0 AS sidecar_ok, partkey % 7 > 2 AS has_ledger, length - partkey % 2 AS ledger_end, length AS data_length FROM {replicas}""",
    ),
    "samples": (
        ("events",),
        """SELECT event_type AS metric, CAST(user_id % 8 AS BIGINT) AS instance, user_id AS series, event_id * 250 AS ts_ms,
             CAST(floor(sum(value) OVER (PARTITION BY event_type, user_id, seg ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS value, CAST(floor(value) AS BIGINT) AS gauge
           FROM (SELECT *, sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seg FROM {events}) e""",
    ),
    "heartbeats": (
        ("events",),
        """SELECT user_id AS node_id, event_id * 250 AS ts_ms, CAST(floor(value) AS BIGINT) AS free_bytes, 1 + CAST(floor(event_id / 3000) AS BIGINT) AS session_epoch FROM {events}""",
    ),
    "system_files": (
        ("orders",),
        """SELECT file_id, '/metadata-log/ns' || CAST(file_id % 5 AS VARCHAR(4)) || '/gen-' || CAST(gen AS VARCHAR(8)) || '/' || kind || '-' || CAST(file_id AS VARCHAR(20)) AS path, created_ms
           FROM (SELECT o_orderkey AS file_id, o_custkey % 12 AS gen, CASE WHEN o_orderkey % 2 = 0 THEN 'log' ELSE 'snapshot' END AS kind, o_orderkey * 40 AS created_ms FROM {orders} WHERE o_orderkey % 9 <> 0) o
           UNION ALL SELECT o_orderkey, '/metadata-log/gen-7/odd-' || CAST(o_orderkey AS VARCHAR(20)), o_orderkey * 40 FROM {orders} WHERE o_orderkey % 9 = 0""",
    ),
    "manifests": (
        ("region",),
        """SELECT 'ns' || CAST(r_regionkey AS VARCHAR(4)) AS namespace, CAST(8 + r_regionkey % 2 AS BIGINT) AS generation, CAST(40 + r_regionkey * 15 AS BIGINT) AS log_file_id, CAST(41 + r_regionkey * 15 AS BIGINT) AS snapshot_file_id
           FROM {region} WHERE r_regionkey < 4""",
    ),
}


class Bound:
    """The tables of a folder and the domain tables bound to them, read and planned when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in PLANS:
                self._made[name] = PLANS[name](self)
            elif name in BINDINGS:
                self._made[name] = self.selected(name)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def selected(self, name: str) -> DataFrame:
        """A binding by its SELECT; of a union that is read in part, Spark then plans only the branches that are needed."""
        needs, text = BINDINGS[name]
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs})


def with_bindings(*names: str) -> str:
    """A WITH clause that defines domain tables for the SQL oracle, ready for more."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in order:
            for n in BINDINGS[name][0]:
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n][1].format(**{x: x for x in BINDINGS[n][0]})})" for n in order)
