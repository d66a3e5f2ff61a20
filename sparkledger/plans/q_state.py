"""Queries over folded state and metrics."""

from pyspark.sql import functions as F

from ..operators import fold as S
from ..operators import metrics as M
from .registry import query

LIFE = """, e AS (SELECT *, last_value(CASE WHEN kind IN ('FileCreated', 'TombstoneSwept') THEN kind END IGNORE NULLS) OVER (PARTITION BY namespace, file_id ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM meta_log),
x AS (SELECT * FROM e WHERE kind = 'FileCreated' OR pm = 'FileCreated'),
b AS (SELECT namespace, file_id, coalesce(max(log_offset) FILTER (WHERE kind = 'TombstoneSwept'), -1) AS sw, max(log_offset) FILTER (WHERE kind = 'FileCreated') AS cr FROM x GROUP BY ALL),
s AS (SELECT x.namespace, x.file_id, arg_max(kind, log_offset) FILTER (WHERE kind IN ('FileCreated', 'FileSealed', 'FileDeleting', 'FileDeleted', 'TombstoneSwept')) AS k, coalesce(arg_max(write_epoch, log_offset) FILTER (WHERE kind = 'WriterEpochAllocated' AND log_offset > cr), 0) AS writer_epoch,
 arg_max(path, log_offset) FILTER (WHERE kind = 'FileCreated') AS path, arg_max(at_ms, log_offset) FILTER (WHERE kind = 'FileDeleted') AS deleted_at_ms, count(*) FILTER (WHERE log_offset > sw AND kind NOT IN ('PathUnbound', 'TombstoneSwept')) - 1 AS version FROM x JOIN b ON b.namespace = x.namespace AND b.file_id = x.file_id GROUP BY x.namespace, x.file_id),
f AS (SELECT namespace, file_id, CASE k WHEN 'FileCreated' THEN 'OPEN' WHEN 'FileSealed' THEN 'SEALED' WHEN 'FileDeleting' THEN 'DELETING' ELSE 'DELETED' END AS state, writer_epoch, path, CASE WHEN k = 'FileDeleted' THEN deleted_at_ms END AS deleted_at_ms, CAST(version AS BIGINT) AS version FROM s WHERE k <> 'TombstoneSwept')"""


@query("fold_files", "meta_log", LIFE + " SELECT * FROM f")
def fold_files(b):
    return S.file_state(b.meta_log)


@query("fold_from_snapshot", "meta_log", LIFE + " SELECT * FROM f")
def fold_from_snapshot(b):
    """The whole fold, by way of a snapshot at a cut and the records after it."""
    return S.resume(*S.snapshot_tail(b.meta_log, 2000))


@query("fold_chunks", "meta_log", LIFE + """, c AS (SELECT x.namespace, x.file_id, idx, arg_max(kind, log_offset) AS k, arg_max(length, log_offset) AS length, arg_max(write_epoch, log_offset) AS write_epoch FROM x JOIN b ON b.namespace = x.namespace AND b.file_id = x.file_id
 WHERE kind LIKE 'Chunk%' AND log_offset > cr AND EXISTS (SELECT 1 FROM meta_log m WHERE m.namespace = x.namespace AND m.file_id = x.file_id AND m.idx = x.idx AND m.kind = 'ChunkCreated' AND m.log_offset <= x.log_offset) GROUP BY ALL)
SELECT c.namespace, c.file_id, c.idx, CASE k WHEN 'ChunkSealed' THEN 'SEALED' ELSE 'OPEN' END AS state, length, write_epoch FROM c JOIN f ON f.namespace = c.namespace AND f.file_id = c.file_id WHERE k <> 'ChunkAborted'""")
def fold_chunks(b):
    return S.chunk_state(b.meta_log)


@query("fold_replicas", "replica_log", """, n AS (SELECT namespace, file_id, idx, log_offset, node_id AS node, kind NOT IN ('ReplicaSwapped', 'ReplicaDropped') AS there FROM replica_log WHERE kind NOT IN ('ChunkDeleted') UNION ALL SELECT namespace, file_id, idx, log_offset, to_node, true FROM replica_log WHERE kind = 'ReplicaSwapped'),
r AS (SELECT namespace, file_id, idx, max(log_offset) FILTER (WHERE kind IN ('ChunkCreated', 'ChunkSealed')) AS begun, bool_or(kind = 'ChunkDeleted') AS gone FROM replica_log GROUP BY ALL),
l AS (SELECT n.namespace, n.file_id, n.idx, node, arg_max(there, log_offset) AS there FROM n JOIN r USING (namespace, file_id, idx) WHERE NOT gone AND log_offset >= begun GROUP BY ALL)
SELECT namespace, file_id, idx, array_to_string(coalesce(list_sort(list(node) FILTER (WHERE there)), []), ',') AS nodes FROM l GROUP BY ALL""")
def fold_replicas(b):
    return S.replica_lists(b.replica_log).select("namespace", "file_id", "idx", F.array_join("replicas", ",").alias("nodes"))


@query("path_bindings", "meta_log", """, c AS (SELECT namespace, path, max(log_offset) AS at_ FROM meta_log WHERE kind = 'FileCreated' GROUP BY ALL)
SELECT m.namespace, m.path, m.file_id FROM c JOIN meta_log m ON m.namespace = c.namespace AND m.log_offset = c.at_ WHERE NOT EXISTS (SELECT 1 FROM meta_log u WHERE u.kind = 'PathUnbound' AND u.namespace = m.namespace AND u.path = m.path AND u.file_id = m.file_id AND u.log_offset > c.at_)""")
def path_bindings(b):
    return S.bindings(b.meta_log)


@query("id_high_water", "meta_log", "SELECT namespace, max(file_id) + 1 AS next_file_id FROM meta_log WHERE kind = 'FileCreated' GROUP BY namespace")
def id_high_water(b):
    return S.high_water(b.selected("meta_log"))


@query("assign_ids", "meta_log files", ", h AS (SELECT namespace, max(file_id) + 1 AS n FROM meta_log WHERE kind = 'FileCreated' GROUP BY namespace) SELECT f.namespace, f.path, CAST(n + row_number() OVER (PARTITION BY f.namespace ORDER BY f.path) - 1 AS BIGINT) AS new_id FROM files f JOIN h ON h.namespace = f.namespace WHERE f.state = 'OPEN'")
def assign_ids(b):
    return S.assign_ids(b.files.filter("state = 'OPEN'").select("namespace", "path"), S.high_water(b.selected("meta_log")), "path").select("namespace", "path", "new_id")


@query("snapshot_at_cut", "meta_log", LIFE.replace("FROM meta_log)", "FROM meta_log WHERE log_offset < 2000)", 1) + " SELECT namespace, state, count(*) AS n FROM f GROUP BY ALL")
def snapshot_at_cut(b):
    return S.snapshot_tail(b.meta_log, 2000)[0].groupBy("namespace", "state").agg(F.count("*").alias("n"))


@query("log_tail", "meta_log", "SELECT namespace, kind, count(*) AS n FROM meta_log WHERE log_offset >= 2000 GROUP BY ALL")
def log_tail(b):
    return S.snapshot_tail(b.meta_log, 2000)[1].groupBy("namespace", "kind").agg(F.count("*").alias("n"))


REPL = "SELECT namespace, file_id, idx, state, node_id, partkey FROM replicas"


def _lists(rows):
    return rows.groupBy("namespace", "file_id", "idx", "state").agg(F.sort_array(F.collect_list("node_id")).alias("replicas"))


@query("descriptor_diff", "replicas", f""", o AS (SELECT * FROM ({REPL}) a WHERE (partkey + node_id) % 7 <> 0 AND file_id % 9 <> 0), n AS (SELECT * FROM ({REPL}) a WHERE (partkey + node_id) % 5 <> 0 AND file_id % 10 <> 0),
oc AS (SELECT DISTINCT namespace, file_id, idx, state FROM o), nc AS (SELECT DISTINCT namespace, file_id, idx, state FROM n),
b AS (SELECT coalesce(oc.namespace, nc.namespace) AS namespace, coalesce(oc.file_id, nc.file_id) AS file_id, coalesce(oc.idx, nc.idx) AS idx, oc.state AS os, nc.state AS ns FROM oc FULL JOIN nc ON oc.namespace = nc.namespace AND oc.file_id = nc.file_id AND oc.idx = nc.idx)
SELECT namespace, file_id, idx, 'ChunkCreated' AS kind, CAST(NULL AS BIGINT) AS node_id FROM b WHERE os IS NULL UNION ALL SELECT namespace, file_id, idx, 'ChunkDeleted', NULL FROM b WHERE ns IS NULL UNION ALL SELECT namespace, file_id, idx, 'ChunkSealed', NULL FROM b WHERE ns = 'SEALED' AND coalesce(os, 'OPEN') <> 'SEALED'
UNION ALL SELECT o.namespace, o.file_id, o.idx, 'ReplicaDropped', o.node_id FROM o JOIN b USING (namespace, file_id, idx) WHERE os = 'SEALED' AND ns = 'SEALED' AND NOT EXISTS (SELECT 1 FROM n WHERE n.namespace = o.namespace AND n.file_id = o.file_id AND n.idx = o.idx AND n.node_id = o.node_id)
UNION ALL SELECT n.namespace, n.file_id, n.idx, 'ReplicaAdded', n.node_id FROM n JOIN b USING (namespace, file_id, idx) WHERE os = 'SEALED' AND ns = 'SEALED' AND NOT EXISTS (SELECT 1 FROM o WHERE n.namespace = o.namespace AND n.file_id = o.file_id AND n.idx = o.idx AND n.node_id = o.node_id)""")
def descriptor_diff(b):
    return S.diff_chunks(_lists(b.replicas.filter("(partkey + node_id) % 7 <> 0 AND file_id % 9 <> 0")), _lists(b.replicas.filter("(partkey + node_id) % 5 <> 0 AND file_id % 10 <> 0")))


@query("seal_file_check", "chunks files", "SELECT c.namespace, c.file_id, CAST(sum(length) AS BIGINT) AS length, bool_and(c.state = 'SEALED') AND sum(length) = sum(length) - sum(CASE WHEN idx = 0 AND c.file_id % 4 = 0 THEN 1 ELSE 0 END) AS may_seal FROM chunks c GROUP BY ALL")
def seal_file_check(b):
    totals = b.chunks.groupBy("namespace", "file_id").agg((F.sum("length") - F.max(F.when(F.col("file_id") % 4 == 0, 1).otherwise(0))).alias("total"))
    return S.seal_file_check(b.chunks, totals)


@query("seal_chunk", "replicas", "SELECT namespace, file_id, idx, count(*) FILTER (WHERE (partkey + node_id) % 3 <> 0) AS n_kept, count(*) FILTER (WHERE (partkey + node_id) % 3 <> 0) >= 2 AS accepted FROM replicas GROUP BY ALL")
def seal_chunk(b):
    requests = b.replicas.groupBy("namespace", "file_id", "idx").agg(F.collect_list("node_id").alias("replicas"), F.expr("collect_list(CASE WHEN (partkey + node_id) % 3 <> 0 THEN node_id END)").alias("sealed"))
    return S.seal_chunk(requests, 2)


REQUEST = "SELECT namespace, CASE WHEN file_id % 5 = 0 THEN path || '/x' ELSE path END AS path, CASE WHEN file_id % 2 = 0 THEN file_id ELSE file_id + 1000000 END AS op FROM {0}"


@query("create_outcomes", "files", ", r AS (" + REQUEST.format("files") + """), o AS (SELECT r.*, f.path AS op_path, f.state AS op_state, EXISTS (SELECT 1 FROM files u WHERE u.namespace = r.namespace AND u.path = r.path AND u.state IN ('OPEN', 'SEALED')) AS used FROM r LEFT JOIN files f ON f.namespace = r.namespace AND f.file_id = r.op)
SELECT namespace, path, op, CASE WHEN op_state = 'DELETED' THEN 'DELETED' WHEN op_path = path THEN 'EXISTS' WHEN op_path IS NOT NULL OR used THEN 'CONFLICT' ELSE 'CREATED' END AS outcome FROM o""")
def create_outcomes(b):
    return S.create_files(b.spark.sql(REQUEST.format("{files}"), files=b.files), b.files.withColumn("op", F.col("file_id")))


@query("live_files_by_namespace", "files", "SELECT namespace, count(*) FILTER (WHERE state <> 'DELETED') AS live, count(*) FILTER (WHERE state = 'DELETED') AS tombstones, count(*) AS total FROM files GROUP BY namespace")
def live_files_by_namespace(b):
    return b.files.groupBy("namespace").agg(F.count_if(F.col("state") != "DELETED").alias("live"), F.count_if(F.col("state") == "DELETED").alias("tombstones"), F.count("*").alias("total"))


@query("live_namespaces", "files", "SELECT DISTINCT namespace FROM files WHERE state <> 'DELETED'")
def live_namespaces(b):
    return b.files.filter("state <> 'DELETED'").select("namespace").distinct()


@query("lookup_files", "files chunks replicas", """, r AS (SELECT namespace, file_id, idx, array_to_string(list_sort(list(node_id)), ',') AS nodes FROM replicas GROUP BY ALL)
SELECT f.namespace, f.file_id, f.path, count(c.idx) AS n_chunks, string_agg(CAST(c.idx AS VARCHAR) || '=' || r.nodes, ';' ORDER BY c.idx) AS layout FROM files f JOIN chunks c ON c.namespace = f.namespace AND c.file_id = f.file_id JOIN r ON r.namespace = c.namespace AND r.file_id = c.file_id AND r.idx = c.idx WHERE f.state IN ('OPEN', 'SEALED') GROUP BY f.namespace, f.file_id, f.path""")
def lookup_files(b):
    nodes = b.replicas.groupBy("namespace", "file_id", "idx").agg(F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("nodes"))
    per = nodes.groupBy("namespace", "file_id").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("idx", "nodes"))).alias("l"))
    layout = F.expr("array_join(transform(l, x -> concat(x.idx, '=', x.nodes)), ';')")
    return b.files.filter("state IN ('OPEN', 'SEALED')").join(per, ["namespace", "file_id"]).select("namespace", "file_id", "path", "n_chunks", layout.alias("layout"))


@query("resolve_path", "files", "SELECT namespace, path, file_id FROM files WHERE state IN ('OPEN', 'SEALED')")
def resolve_path(b):
    wanted = b.files.select("namespace", "path")
    return wanted.join(b.files.filter("state IN ('OPEN', 'SEALED')").select("namespace", "path", "file_id"), ["namespace", "path"])


@query("delete_codes", "files", "SELECT q.id, CASE WHEN f.file_id IS NULL THEN 'FILE_NOT_FOUND' WHEN f.state IN ('DELETING', 'DELETED') THEN 'ALREADY' ELSE 'OK' END AS code FROM (SELECT DISTINCT o_orderkey * 2 AS id FROM orders) q LEFT JOIN files f ON f.file_id = q.id")
def delete_codes(b):
    ids = b.orders.select((F.col("o_orderkey") * 2).alias("id")).distinct()
    return ids.join(b.files.select(F.col("file_id").alias("id"), "state"), "id", "left").select("id", F.when(F.col("state").isNull(), "FILE_NOT_FOUND").when(F.col("state").isin("DELETING", "DELETED"), "ALREADY").otherwise("OK").alias("code"))


@query("writer_epochs", "chunks files", "SELECT f.namespace, f.file_id, greatest(max(f.writer_epoch), max(c.write_epoch)) AS epoch, greatest(max(f.writer_epoch), max(c.write_epoch)) + 1 AS next_epoch FROM files f JOIN chunks c ON c.file_id = f.file_id AND c.namespace = f.namespace GROUP BY f.namespace, f.file_id")
def writer_epochs(b):
    top = b.chunks.groupBy("namespace", "file_id").agg(F.max("write_epoch").alias("top"))
    epoch = F.greatest("writer_epoch", "top")
    return b.files.join(top, ["namespace", "file_id"]).select("namespace", "file_id", epoch.alias("epoch"), (epoch + 1).alias("next_epoch"))


@query("next_chunk", "chunks", "SELECT namespace, file_id, max(idx) + 1 AS next_idx, arg_max(state, idx) = 'OPEN' AS tail_open FROM chunks GROUP BY ALL")
def next_chunk(b):
    return b.chunks.groupBy("namespace", "file_id").agg((F.max("idx") + 1).alias("next_idx"), (F.max_by("state", "idx") == "OPEN").alias("tail_open"))


@query("node_chunk_index", "replicas files", "SELECT node_id, count(*) AS n_chunks, min(r.file_id) AS first_file FROM replicas r JOIN files f ON f.file_id = r.file_id AND f.namespace = r.namespace WHERE f.state IN ('OPEN', 'SEALED') GROUP BY node_id")
def node_chunk_index(b):
    live = b.files.filter("state IN ('OPEN', 'SEALED')").select("namespace", "file_id")
    return b.replicas.join(live, ["namespace", "file_id"], "left_semi").groupBy("node_id").agg(F.count("*").alias("n_chunks"), F.min("file_id").alias("first_file"))


@query("chunk_states", "chunks", "SELECT namespace, state, count(*) AS n, CAST(sum(length) AS BIGINT) AS used_bytes FROM chunks GROUP BY ALL")
def chunk_states(b):
    return b.chunks.groupBy("namespace", "state").agg(F.count("*").alias("n"), F.sum("length").alias("used_bytes"))


@query("node_usage", "replicas nodes", "SELECT n.node_id, CAST(coalesce(sum(r.length), 0) AS BIGINT) AS used, CASE WHEN n.capacity_bytes > 0 THEN round(coalesce(sum(r.length), 0) / n.capacity_bytes, 6) END AS ratio FROM nodes n LEFT JOIN replicas r ON r.node_id = n.node_id GROUP BY n.node_id, n.capacity_bytes")
def node_usage(b):
    used = b.replicas.groupBy("node_id").agg(F.sum("length").alias("u"))
    u = F.coalesce("u", F.lit(0))
    return b.nodes.join(used, "node_id", "left").select("node_id", u.alias("used"), F.when(F.col("capacity_bytes") > 0, F.round(u / F.col("capacity_bytes"), 6)).alias("ratio"))


@query("namespace_io", "records", "SELECT coalesce(namespace, 'all') AS namespace, count(*) AS append_ops, CAST(sum(length) AS BIGINT) AS append_bytes FROM records GROUP BY ROLLUP (namespace)")
def namespace_io(b):
    return b.records.rollup("namespace").agg(F.count("*").alias("append_ops"), F.sum("length").alias("append_bytes")).withColumn("namespace", F.coalesce("namespace", F.lit("all")))


@query("latest_heartbeat", "heartbeats", "SELECT node_id, max(ts_ms) AS ts_ms, arg_max(free_bytes, ts_ms) AS free_bytes, arg_max(session_epoch, ts_ms) AS session_epoch FROM heartbeats GROUP BY node_id")
def latest_heartbeat(b):
    return b.heartbeats.groupBy("node_id").agg(F.max("ts_ms").alias("ts_ms"), F.max_by("free_bytes", "ts_ms").alias("free_bytes"), F.max_by("session_epoch", "ts_ms").alias("session_epoch"))


@query("stale_heartbeats", "heartbeats", ", l AS (SELECT node_id, max(session_epoch) AS e FROM heartbeats GROUP BY node_id) SELECT h.node_id, count(*) AS n FROM heartbeats h JOIN l ON l.node_id = h.node_id WHERE h.session_epoch < e GROUP BY h.node_id")
def stale_heartbeats(b):
    newest = b.heartbeats.groupBy("node_id").agg(F.max("session_epoch").alias("e"))
    return b.heartbeats.join(newest, "node_id").filter("session_epoch < e").groupBy("node_id").agg(F.count("*").alias("n"))


@query("instant_gauges", "samples", ", l AS (SELECT metric, instance, series, arg_max(gauge, ts_ms) AS value FROM samples GROUP BY ALL) SELECT metric, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, max(value) AS high, min(value) AS low FROM l WHERE regexp_full_match(metric, 'c.*|view') GROUP BY metric")
def instant_gauges(b):
    return M.instant(b.samples.filter(F.col("metric").rlike("^(?:c.*|view)$")), "gauge").groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"), F.min("value").alias("low"))


WINDOW_MS = 2000000
INC = f""", w AS (SELECT *, CAST(floor((ts_ms - 1) / {WINDOW_MS}) AS BIGINT) AS slot FROM samples), l AS (SELECT *, lag(value) OVER (PARTITION BY metric, instance, series, slot ORDER BY ts_ms) AS prev FROM w),
i AS (SELECT metric, instance, series, slot, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS BIGINT) AS increase FROM l GROUP BY ALL)"""


@query("counter_increase", "samples", INC + " SELECT * FROM i")
def counter_increase(b):
    return M.increases_by_window(b.samples, WINDOW_MS)


@query("rate_by_metric", "samples", INC + f" SELECT metric, instance, slot, round(sum(increase) * 1000.0 / {WINDOW_MS}, 6) AS rate FROM i GROUP BY ALL")
def rate_by_metric(b):
    return M.rate_by_window(b.samples, WINDOW_MS, ["metric", "instance"]).withColumn("rate", F.round("rate", 6))


_LE = " UNION ALL ".join(f"SELECT metric, CAST({x} AS DOUBLE) AS le, count(*) FILTER (WHERE gauge <= {x}) AS cum FROM samples GROUP BY metric" for x in M.BOUNDS_MS) + " UNION ALL SELECT metric, CAST('Infinity' AS DOUBLE), count(*) FROM samples GROUP BY metric"


@query("latency_quantile", "samples", f""", h AS ({_LE}), p AS (SELECT metric, le, cum, coalesce(lag(le) OVER (PARTITION BY metric ORDER BY le), 0) AS lo, coalesce(lag(cum) OVER (PARTITION BY metric ORDER BY le), 0) AS below, max(cum) OVER (PARTITION BY metric) AS total FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY le) AS r FROM p WHERE cum >= 0.9 * total) SELECT metric, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.9 * total - below) / greatest(cum - below, 1) END, 6) AS quantile FROM f WHERE r = 1""")
def latency_quantile(b):
    return M.histogram_quantile(M.buckets(b.samples, "gauge", ["metric"]), 0.9, ["metric"]).withColumn("quantile", F.round("quantile", 6))


@query("nearest_rank", "records", "SELECT namespace, quantile_disc(length, 0.5) AS p50, quantile_disc(length, 0.95) AS p95, quantile_disc(length, 0.99) AS p99, max(length) AS highest FROM records GROUP BY namespace")
def nearest_rank(b):
    return M.nearest_rank(b.records, "length", ["namespace"])


@query("throughput", "records", "SELECT namespace, CAST(floor(ts_ms / 5000) AS BIGINT) AS slot, sum(length) * 1000.0 / 5000 AS bytes_per_s, count(*) * 1000.0 / 5000 AS ops_per_s FROM records GROUP BY ALL")
def throughput(b):
    return M.throughput(b.records, 5000)


@query("ring_buffer", "samples", ", k AS (SELECT metric, instance, series, ts_ms, gauge, row_number() OVER (PARTITION BY metric, instance, series ORDER BY ts_ms DESC) AS n FROM samples) SELECT metric, instance, series, ts_ms, gauge FROM k WHERE n <= 3")
def ring_buffer(b):
    return M.last_observations(b.samples.select(*M.SERIES, "ts_ms", "gauge"), 3)


@query("token_bucket", "records", """, s AS (SELECT *, coalesce(sum(length * 40) OVER (PARTITION BY namespace ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM records)
SELECT namespace, event_id, CAST(greatest(ts_ms, bf + max(ts_ms - 2000 - bf) OVER (PARTITION BY namespace ORDER BY event_id)) AS BIGINT) AS start FROM s""")
def token_bucket(b):
    return M.paced(b.records.withColumn("cost", F.col("length") * 40), "cost", 2000, ["namespace"], "event_id", "ts_ms").select("namespace", "event_id", "start")


@query("unhealthy_since", "samples", """, h AS (SELECT metric, series, ts_ms, gauge < 60 AS ok FROM samples), i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY metric, series ORDER BY ts_ms) AS isl FROM h)
SELECT metric, series, ts_ms, min(ts_ms) OVER (PARTITION BY metric, series, isl) AS since FROM i WHERE NOT ok""")
def unhealthy_since(b):
    return M.unhealthy_since(b.samples.select("metric", "series", "ts_ms", (F.col("gauge") < 60).alias("ok")), "ok", ["metric", "series"], "ts_ms").select("metric", "series", "ts_ms", "since")


@query("leader_product", "samples", ", l AS (SELECT metric, instance, series, arg_max(gauge, ts_ms) AS value FROM samples GROUP BY ALL), r AS (SELECT instance, max(CASE WHEN instance % 2 = 0 THEN 1 ELSE 0 END) AS factor FROM samples GROUP BY instance) SELECT l.instance, metric, series, value, value * factor AS product FROM l JOIN r ON r.instance = l.instance")
def leader_product(b):
    right = b.samples.select("instance", F.when(F.col("instance") % 2 == 0, 1).otherwise(0).alias("value")).distinct()
    return M.matched_product(M.instant(b.samples, "gauge"), right, ["instance"]).select("instance", "metric", "series", "value", "product")
