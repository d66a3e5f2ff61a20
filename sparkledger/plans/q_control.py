"""Queries over requests, repairs, recovery and verification."""

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import health as H
from ..operators import placement as P
from ..operators import replica as R
from ..operators.votes import CHUNK
from .registry import query

ON = "{0}.namespace = {1}.namespace AND {0}.file_id = {1}.file_id AND {0}.idx = {1}.idx"


@query("seal_replica", "replica_states", """SELECT namespace, file_id, idx, node_id, ask_length AS data_length, CASE WHEN ask_epoch < greatest(fence_epoch, write_epoch) THEN 'FENCED_EPOCH' WHEN state = 'SEALED' THEN CASE WHEN sealed_length = ask_length THEN 'OK' ELSE 'CHUNK_SEALED' END
 WHEN ask_length > local_end OR ask_length < last_known_do THEN 'INTERNAL' WHEN state = 'DELETING' THEN 'CHUNK_NOT_FOUND' ELSE 'OK' END AS code FROM replica_states""")
def seal_replica(b):
    asked = b.replica_states.select(*R.REPLICA, F.col("ask_epoch").alias("epoch"), F.col("ask_length").alias("data_length"))
    return R.seal_codes(asked, b.replica_states.drop("ask_epoch", "ask_length"))


OPENED = "SELECT partkey + node_id AS request, namespace, file_id, idx + CASE WHEN (partkey + node_id) % 3 = 0 THEN 0 ELSE 100 END AS idx, node_id FROM {0}"


@query("open_replica", "replica_states", f", q AS ({OPENED.format('replica_states')}) SELECT q.request, q.namespace, q.file_id, q.idx, q.node_id, CASE WHEN q.idx < 100 THEN 'CHUNK_ALREADY_EXISTS' ELSE 'OK' END AS code FROM q")
def open_replica(b):
    return R.open_codes(b.spark.sql(OPENED.format("{t}"), t=b.replica_states), b.replica_states)


@query("delete_replica", "replica_states", f", q AS ({OPENED.format('replica_states')}) SELECT namespace, file_id, idx, node_id, CASE WHEN idx < 100 THEN 'OK' ELSE 'CHUNK_NOT_FOUND' END AS code FROM q")
def delete_replica(b):
    return R.delete_codes(b.spark.sql(OPENED.format("{t}"), t=b.replica_states), b.replica_states)


@query("delete_counters", "replica_states", f", q AS ({OPENED.format('replica_states')}) SELECT CASE WHEN idx < 100 THEN 'OK' ELSE 'CHUNK_NOT_FOUND' END AS code, count(*) AS n FROM q GROUP BY 1")
def delete_counters(b):
    return delete_replica(b).groupBy("code").agg(F.count("*").alias("n"))


@query("fetch_pages", "replica_states", """SELECT namespace, file_id, idx, node_id, CAST(o AS BIGINT) AS "offset", CAST(least(16, sealed_length - o) AS BIGINT) AS n_bytes FROM (SELECT *, unnest(range(0, sealed_length, 16)) AS o FROM replica_states WHERE state = 'SEALED') p""")
def fetch_pages(b):
    return R.fetch_pages(b.replica_states, 16)


@query("describe_chunks", "replica_states", "SELECT node_id, namespace, file_id, idx, state, local_end, last_known_do, write_epoch, fence_epoch, CASE WHEN state = 'SEALED' THEN sealed_length END AS sealed_length FROM replica_states")
def describe_chunks(b):
    return b.replica_states.select("node_id", *CHUNK, "state", "local_end", "last_known_do", "write_epoch", "fence_epoch", F.when(F.col("state") == "SEALED", F.col("sealed_length")).alias("sealed_length"))


@query("stat_chunks", "chunks replica_states", "SELECT c.namespace, c.file_id, c.idx, r.node_id, coalesce(r.state, 'ABSENT') AS state, r.local_end FROM chunks c LEFT JOIN replica_states r ON " + ON.format("c", "r") + " AND r.node_id = c.suppkey")
def stat_chunks(b):
    asked = b.chunks.select(*CHUNK, F.col("suppkey").alias("node_id"))
    return asked.join(b.replica_states.select(*R.REPLICA, "state", "local_end", F.lit(True).alias("there")), R.REPLICA, "left").select(*CHUNK, F.when(F.col("there"), F.col("node_id")).alias("node_id"), F.coalesce("state", F.lit("ABSENT")).alias("state"), "local_end")


@query("footer_stats", "records", ", s AS (SELECT namespace, file_id, max(end_offset) * 7 // 10 AS sealed FROM records GROUP BY ALL) SELECT r.namespace, r.file_id, sealed, max(end_offset) FILTER (WHERE end_offset <= sealed) AS last_end, count(*) FILTER (WHERE end_offset <= sealed) AS entries FROM records r JOIN s ON s.namespace = r.namespace AND s.file_id = r.file_id GROUP BY ALL")
def footer_stats(b):
    lengths = b.records.groupBy("namespace", "file_id").agg(F.expr("max(end_offset) * 7 DIV 10").alias("length"))
    return R.footer_stats(b.records.select("namespace", "file_id", "end_offset"), lengths, ["namespace", "file_id"])


@query("durable_floor", "replica_states", "SELECT namespace, file_id, idx, max(last_known_do) AS floor FROM replica_states WHERE last_known_do BETWEEN 0 AND local_end GROUP BY ALL")
def durable_floor(b):
    return R.durable_floor(b.replica_states)


@query("sane_responses", "replica_states", "SELECT node_id, count(*) AS n FROM replica_states WHERE last_known_do >= 0 AND local_end >= last_known_do GROUP BY node_id")
def sane_responses(b):
    return R.sane_responses(b.replica_states).groupBy("node_id").agg(F.count("*").alias("n"))


@query("flush_due", "replica_states", "SELECT namespace, file_id, idx, node_id, local_end - flushed AS dirty FROM replica_states WHERE local_end >= flushed + 6")
def flush_due(b):
    return R.flush_due(b.replica_states, 6).select(*R.REPLICA, (F.col("local_end") - F.col("flushed")).alias("dirty"))


@query("chosen_response", "responses", """, v AS (SELECT request, attempt, node_id, got, ok AND durable >= 0 AND durable <= end_at AND got <= want AND at_offset + got <= CASE WHEN sealed THEN end_at ELSE least(end_at, durable) END AND NOT (sealed AND got = 0 AND at_offset < end_at) AS valid FROM responses),
f AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY attempt) AS k FROM v WHERE valid) SELECT n.request, n.attempts, f.attempt, f.node_id, f.got FROM (SELECT request, count(*) AS attempts FROM responses GROUP BY request) n LEFT JOIN f ON f.request = n.request AND k = 1""")
def chosen_response(b):
    return R.chosen_response(b.responses)


@query("restart_class", "probes", """SELECT namespace, file_id, idx, node_id, CASE WHEN trailer_ok AND NOT (has_ledger AND ledger_end <> data_length) THEN 'SEALED' WHEN trailer_like AND NOT (trailer_ok OR has_sidecar OR has_ledger) THEN 'CORRUPT' WHEN has_sidecar AND sidecar_ok THEN 'OPEN' WHEN has_ledger THEN 'REBUILT' ELSE 'QUARANTINED' END AS class FROM probes""")
def restart_class(b):
    return R.restart_class(b.probes).select(*R.REPLICA, "class")


FAULTS = """array_to_string(list_filter([CASE WHEN header_id <> chunk_id THEN 'header-id' END, CASE WHEN trailer_length <> length THEN 'trailer-length' END, CASE WHEN data_crc <> crc THEN 'data-crc' END, CASE WHEN trailer_crc <> crc THEN 'trailer-crc' END,
 CASE WHEN footer_start <> 64 + length THEN 'footer-start' END, CASE WHEN footer_start > trailer_offset THEN 'footer-overlap' END, CASE WHEN trailer_footer_crc <> 7 THEN 'footer-crc' END], lambda x: x IS NOT NULL), ',')"""


@query("raw_image_faults", "images", f"SELECT namespace, file_id, idx, node_id, {FAULTS} AS faults FROM images")
def raw_image_faults(b):
    return R.raw_image_faults(b.images).select(*R.REPLICA, F.array_join("faults", ",").alias("faults"))


@query("import_sealed", "images", f"SELECT {FAULTS} = '' AS accepted, count(*) AS n FROM images GROUP BY 1")
def import_sealed(b):
    return R.raw_image_faults(b.images).groupBy((F.size("faults") == 0).alias("accepted")).agg(F.count("*").alias("n"))


@query("catch_up_donors", "holdings", """, v AS (SELECT namespace, file_id, idx, digest, count(DISTINCT node_id) AS n FROM holdings WHERE end_at >= to_offset AND digest IS NOT NULL GROUP BY ALL),
p AS (SELECT namespace, file_id, idx, count(*) AS k, max(n) AS best, arg_max(digest, n * 1000 + ascii(digest)) AS d FROM v GROUP BY ALL)
SELECT namespace, file_id, idx, CASE WHEN best >= 2 THEN 'QUORUM' WHEN k > 1 THEN 'CORRUPT_CHUNK' ELSE 'SINGLE' END AS outcome, CASE WHEN best >= 2 OR k = 1 THEN d END AS digest FROM p""")
def catch_up_donors(b):
    return R.catch_up(b.holdings, 2)


HELD = "SELECT namespace, file_id, 0 AS idx, node_id, end_offset, CASE WHEN (event_id + node_id) % 41 = 0 THEN 'rot' ELSE CAST(event_id AS VARCHAR(20)) END AS digest FROM {0}"


@query("conflicts_above_floor", "acks", f""", h AS ({HELD.format('acks')}), c AS (SELECT namespace, file_id, node_id, CAST(floor(max(end_offset) * 0.5) AS BIGINT) AS f, max(end_offset) AS e FROM h GROUP BY ALL)
SELECT c.namespace, c.file_id, 0 AS idx, c.node_id AS candidate, count(*) FILTER (WHERE a.digest <> o.digest) AS differ, count(*) FILTER (WHERE a.digest <> o.digest) > 0 AS conflict FROM c JOIN h a ON a.namespace = c.namespace AND a.file_id = c.file_id AND a.node_id = c.node_id AND a.end_offset > f AND a.end_offset <= e
 JOIN h o ON o.namespace = a.namespace AND o.file_id = a.file_id AND o.end_offset = a.end_offset AND o.node_id <> a.node_id GROUP BY c.namespace, c.file_id, c.node_id""")
def conflicts_above_floor(b):
    held = b.spark.sql(HELD.format("{t}"), t=b.acks)
    return R.conflicts(held, held.groupBy(*CHUNK, "node_id").agg(F.floor(F.max("end_offset") * 0.5).cast("bigint").alias("floor"), F.max("end_offset").alias("end")))


@query("as_of_durable", "records acks", """, t AS (SELECT namespace, file_id, event_id, ts_ms + 40 AS at_ms FROM records), k AS (SELECT namespace, file_id, ack_ms AS at_ms, max(end_offset) AS known FROM acks WHERE node_id = 1 GROUP BY ALL)
SELECT t.namespace, t.file_id, t.event_id, k.known FROM t ASOF LEFT JOIN k ON k.namespace = t.namespace AND k.file_id = t.file_id AND t.at_ms >= k.at_ms""")
def as_of_durable(b):
    known = b.acks.filter("node_id = 1").groupBy("namespace", "file_id", F.col("ack_ms").alias("at_ms")).agg(F.max("end_offset").alias("known"))
    return R.as_of(b.records.select("namespace", "file_id", "event_id", (F.col("ts_ms") + 40).alias("at_ms")), known, ["namespace", "file_id"], "at_ms", "known").select("namespace", "file_id", "event_id", "known")


@query("piggybacked_durable", "records", ", p AS (SELECT *, end_offset - length AS before, end_offset - event_id % 90 AS told FROM records) SELECT namespace, file_id, seq, CAST(max(least(told, before)) OVER (PARTITION BY namespace, file_id ORDER BY seq) AS BIGINT) AS known FROM p")
def piggybacked_durable(b):
    told = b.records.select("namespace", "file_id", "seq", "length", (F.col("end_offset") - F.col("event_id") % 90).alias("told"))
    return R.piggybacked(told, ["namespace", "file_id"], "seq").select("namespace", "file_id", "seq", "known")


@query("resurrections", "meta_log", """SELECT m.namespace, m.file_id, m.log_offset, m.kind FROM meta_log m WHERE m.kind IN ('FileSealed', 'FileDeleting', 'ChunkCreated') AND (SELECT arg_max(d.kind, d.log_offset) FROM meta_log d WHERE d.namespace = m.namespace AND d.file_id = m.file_id AND d.log_offset < m.log_offset AND d.kind IN ('FileCreated', 'FileDeleted', 'TombstoneSwept')) IN ('FileDeleted', 'TombstoneSwept')""")
def resurrections(b):
    return R.resurrections(b.meta_log)


LINES = "SELECT file_id AS artifact, CASE file_id % 4 WHEN 0 THEN 'files=' WHEN 1 THEN 'files = 3' WHEN 2 THEN 'note' ELSE 'acked_bytes=7=8' END AS value FROM {0}"


@query("artifact_audit", "files", f", l AS ({LINES.format('files')}), r AS (SELECT unnest(['files', 'acked_bytes']) AS key) SELECT DISTINCT l.artifact, r.key FROM l CROSS JOIN r WHERE NOT (l.value LIKE r.key || '%=%' AND trim(substr(l.value, strpos(l.value, '=') + 1)) <> '')")
def artifact_audit(b):
    return R.missing_keys(b.spark.sql(LINES.format("{t}"), t=b.files), ["files", "acked_bytes"])


@query("fan_out", "records", "SELECT namespace, file_id, seq, n AS node_id FROM records CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 2) x WHERE event_id % 2 = 0 OR n = 0")
def fan_out(b):
    live = b.records.select("namespace", "file_id", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("node_id"), (F.col("event_id") % 2 == 0).alias("even")).withColumn("live", (F.col("node_id") == 0) | (F.col("node_id") == 2) & F.col("even"))
    return C.fan_out(b.records.select("namespace", "file_id", "seq"), live, ["namespace", "file_id", "seq"])


@query("abort_codes", "aborts chunks files", """, t AS (SELECT namespace, file_id, max(idx) AS tidx, arg_max(state, idx) AS ts, arg_max(write_epoch, idx) AS te, arg_max(suppkey, idx) AS top FROM chunks GROUP BY ALL),
q AS (SELECT a.*, f.state AS fs, f.writer_epoch AS fe, t.tidx, t.ts, t.te, t.top FROM aborts a LEFT JOIN files f ON f.namespace = a.namespace AND f.file_id = a.file_id LEFT JOIN t ON t.namespace = a.namespace AND t.file_id = a.file_id),
c AS (SELECT *, CASE WHEN fs IS NULL OR fs = 'DELETED' THEN 'OK' WHEN fs = 'DELETING' THEN 'PRECONDITION_FAILED' WHEN idx > tidx THEN 'OK' WHEN idx < tidx OR ts <> 'OPEN' THEN 'PRECONDITION_FAILED' WHEN write_epoch < fe OR te <> write_epoch OR top <> op THEN 'FENCED_EPOCH' ELSE 'OK' END AS code FROM q)
SELECT namespace, file_id, idx, write_epoch, op, code, code = 'OK' AND idx = tidx AND fs <> 'DELETED' AS aborts FROM c""")
def abort_codes(b):
    return C.abort_codes(b.aborts, b.files, b.chunks.withColumn("op", F.col("suppkey")))


@query("mark_deleting", "files", "SELECT namespace, file_id, path, unnest(['FileDeleting', 'PathUnbound']) AS kind FROM files WHERE state NOT IN ('DELETING', 'DELETED') AND file_id % 3 <> 1")
def mark_deleting(b):
    return C.mark_deleting(b.files.filter("file_id % 3 <> 1").select("namespace", "file_id"), b.files)


@query("finish_delete", "files chunks", """, d AS (SELECT * FROM files f WHERE state = 'DELETING' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.file_id AND c.partkey % 3 = 0))
SELECT namespace, file_id, 'FileDeleted' AS kind, 777 AS at_ms FROM d UNION ALL SELECT namespace, file_id, 'PathUnbound', 777 FROM d WHERE file_id % 2 = 0""")
def finish_delete(b):
    bound = b.files.select("namespace", "path", F.expr("CASE WHEN file_id % 2 = 0 THEN file_id ELSE -1 END AS file_id"))
    return C.finish_delete(b.files, bound, b.chunks.filter("partkey % 3 = 0"), 777)


VALID = "r.node_id >= 1 AND r.endpoint <> 'noport' AND trim(r.rack) <> '' AND r.capacity_bytes > 0"


@query("register_nodes", "registrations nodes", f"SELECT r.node_id, r.incarnation, CASE WHEN NOT ({VALID}) OR (n.node_id IS NOT NULL AND r.incarnation <> n.node_id AND n.lease_until_ms + 200 >= 4000) THEN 'PRECONDITION_FAILED' ELSE 'OK' END AS code FROM registrations r LEFT JOIN nodes n ON n.node_id = r.node_id")
def register_nodes(b):
    held = b.nodes.select("node_id", F.col("node_id").alias("incarnation"), "lease_until_ms")
    return C.register_codes(b.registrations.withColumn("endpoints", F.array("endpoint")), held, 4000, 200).select("node_id", "incarnation", "code")


@query("valid_registrations", "registrations", f"SELECT r.node_id, r.incarnation, {VALID} AS ok FROM registrations r")
def valid_registrations(b):
    return b.registrations.withColumn("endpoints", F.array("endpoint")).select("node_id", "incarnation", C.valid_registration().alias("ok"))


@query("published_nodes", "nodes", "SELECT node_id, host, free_bytes, 900 AS published_ms FROM nodes WHERE state = 'REGISTERED' AND lease_until_ms >= 900")
def published_nodes(b):
    return C.published_nodes(b.nodes, 900)


SNAPSHOT = "SELECT node_id, free_bytes + 1 AS free_bytes, CASE WHEN node_id % 5 = 0 THEN 10 ELSE 800 END AS published_ms FROM {0} WHERE node_id % 2 = 0"


@query("placement_candidates", "nodes", f""", m AS (SELECT * FROM nodes WHERE node_id % 3 <> 0 AND state = 'REGISTERED' AND lease_until_ms + 200 >= 900), s AS ({SNAPSHOT.format('nodes')})
SELECT node_id, free_bytes, 'memory' AS source FROM m UNION ALL SELECT node_id, free_bytes, 'snapshot' FROM s WHERE 900 - published_ms < 100 + 400 AND node_id NOT IN (SELECT node_id FROM m)""")
def placement_candidates(b):
    return C.candidates(b.nodes.filter("node_id % 3 <> 0"), b.spark.sql(SNAPSHOT.format("{t}"), t=b.nodes), 900, 100, 200)


@query("accepted_completions", "completions inflight", """, a AS (SELECT c.*, row_number() OVER (PARTITION BY c.command_id ORDER BY c.at_ms, c.status) AS k FROM completions c JOIN inflight i ON i.command_id = c.command_id AND i.executing_node = c.node_id WHERE c.session_epoch = 1 + c.node_id % 2)
SELECT command_id, node_id, status, at_ms FROM a WHERE k = 1""")
def accepted_completions(b):
    sessions = b.spark.range(8).selectExpr("id AS node_id", "1 + id % 2 AS session_epoch")
    return C.accepted_completions(b.completions, b.inflight, sessions)


ACTIONS = "SELECT namespace, file_id, idx, CASE WHEN partkey % 3 = 0 THEN NULL WHEN partkey % 3 = 1 THEN max(node_id) ELSE -5 END AS dead_node, CASE WHEN partkey % 4 = 0 THEN min(node_id) ELSE 1 + (partkey * 7) % 90 END AS target_node FROM {0} GROUP BY namespace, file_id, idx, partkey"


@query("swap_outcomes", "replicas files nodes", f""", a AS ({ACTIONS.format('replicas')}), m AS (SELECT namespace, file_id, idx, list(node_id) AS ids FROM replicas WHERE (partkey + node_id) % 5 <> 0 GROUP BY ALL)
SELECT a.namespace, a.file_id, a.idx, a.dead_node, a.target_node, CASE WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = a.target_node AND n.state = 'DEAD') THEN 'TARGET_DEAD' WHEN f.state IS NULL OR f.state = 'DELETED' OR ids IS NULL THEN 'GONE' WHEN f.state = 'DELETING' THEN 'DELETING' WHEN list_contains(ids, target_node) THEN 'MEMBER'
 WHEN dead_node IS NOT NULL THEN CASE WHEN list_contains(ids, dead_node) THEN 'SWAPPED' ELSE 'UNCHANGED' END WHEN len(ids) < 3 THEN 'ADDED' ELSE 'UNCHANGED' END AS outcome FROM a LEFT JOIN files f ON f.namespace = a.namespace AND f.file_id = a.file_id LEFT JOIN m ON {ON.format('m', 'a')}""")
def swap_outcomes(b):
    return C.swap_outcomes(b.spark.sql(ACTIONS.format("{t}"), t=b.replicas), b.files, b.replicas.filter("(partkey + node_id) % 5 <> 0"), b.nodes)


@query("confirm_deletes", "replicas files", """, p AS (SELECT namespace, file_id, idx, count(*) FILTER (WHERE partkey % 2 = 0 OR node_id % 3 = 0) AS gone, count(*) AS n FROM replicas GROUP BY ALL)
SELECT p.namespace, p.file_id, p.idx, n - gone AS "left", CASE WHEN n > gone THEN 'SHRINK' WHEN f.state = 'DELETING' THEN 'DROP_CHUNK' ELSE 'KEEP_EMPTY' END AS outcome FROM p JOIN files f ON f.namespace = p.namespace AND f.file_id = p.file_id WHERE gone > 0 AND f.state <> 'DELETED'""")
def confirm_deletes(b):
    return C.confirm_deletes(b.replicas.filter("partkey % 2 = 0 OR node_id % 3 = 0"), b.files, b.replicas)


@query("owner_repairs", "replicas nodes", """, p AS (SELECT r.namespace, r.file_id, r.idx, count(*) AS members, min(r.node_id) FILTER (WHERE n.state = 'DEAD') AS dead_node, min(r.node_id) FILTER (WHERE n.state IS DISTINCT FROM 'DEAD') AS source_node FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id
 WHERE r.namespace <> 'ns2' AND (r.partkey + r.node_id) % 9 <> 0 GROUP BY ALL) SELECT namespace, file_id, idx, members, dead_node, source_node, members - CASE WHEN dead_node IS NULL THEN 0 ELSE 1 END AS live FROM p WHERE source_node IS NOT NULL AND (dead_node IS NOT NULL OR members < 3) AND file_id % 4 <> 0""")
def owner_repairs(b):
    owned = b.files.filter("namespace <> 'ns2'")
    return C.owner_repairs(b.replicas.filter("(partkey + node_id) % 9 <> 0"), b.nodes.filter("state = 'DEAD'"), owned, b.chunks.filter("file_id % 4 = 0"), 3)


HELD_BY = "SELECT namespace, file_id AS owner, 1 + file_id % 100 AS epoch FROM {0} WHERE file_id % 50 = 0"


@query("fenced_manifests", "files", f", m AS ({HELD_BY.format('files')}) SELECT m.namespace, m.owner, m.epoch, m.epoch = t.top AS holds FROM m JOIN (SELECT namespace, max(epoch) AS top FROM m GROUP BY namespace) t ON t.namespace = m.namespace")
def fenced_manifests(b):
    return C.fenced_manifests(b.spark.sql(HELD_BY.format("{t}"), t=b.files))


@query("compaction_due", "records", "SELECT namespace, CAST(sum(length) AS BIGINT) AS open_bytes FROM records GROUP BY namespace HAVING sum(length) >= 1000")
def compaction_due(b):
    return C.compaction_due(b.records.groupBy("namespace").agg(F.sum("length").alias("open_bytes")), 1000)


LOG_COUNTERS = ("appends", "append_bytes", "append_failures", "syncs", "snapshots", "snapshot_bytes", "compactions", "recoveries", "fences")
LOG_ROWS = """SELECT event_type AS namespace, 1 AS appends, length(props) AS append_bytes, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS append_failures, CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END AS syncs, CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END AS snapshots,
 CASE WHEN event_id % 500 = 0 THEN event_id ELSE 0 END AS snapshot_bytes, CASE WHEN event_id % 1000 = 0 THEN 1 ELSE 0 END AS compactions, CASE WHEN event_id % 1500 = 0 THEN 1 ELSE 0 END AS recoveries, CASE WHEN event_id % 1700 = 0 THEN 1 ELSE 0 END AS fences FROM {0}"""


@query("metadata_log_counters", "", f"WITH l AS ({LOG_ROWS.format('events')}) SELECT coalesce(namespace, 'all') AS namespace, " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in LOG_COUNTERS) + " FROM l GROUP BY ROLLUP (namespace)")
def metadata_log_counters(b):
    return C.counters(b.spark.sql(LOG_ROWS.format("{t}"), t=b.events), list(LOG_COUNTERS))


@query("all_namespaces", "files manifests", "SELECT namespace FROM files WHERE state <> 'DELETED' UNION SELECT namespace FROM manifests UNION SELECT '__system'")
def all_namespaces(b):
    system = b.spark.sql("SELECT '__system' AS namespace")
    return b.files.filter("state <> 'DELETED'").select("namespace").union(b.manifests.select("namespace")).union(system).distinct()


@query("list_nodes", "nodes", "SELECT node_id, endpoint, host, zone, state, capacity_bytes FROM nodes")
def list_nodes(b):
    return b.nodes.select("node_id", "endpoint", "host", "zone", "state", "capacity_bytes")


@query("eligible_without", "nodes", "SELECT node_id FROM nodes WHERE state = 'REGISTERED' AND lease_until_ms + 200 >= 400 AND free_bytes > 0 AND node_id % 4 <> 0 AND host NOT IN ('h1', 'h2')")
def eligible_without(b):
    return P.without(P.eligible(b.nodes, 400, 200), b.nodes.filter("node_id % 4 = 0"), b.nodes.filter("host IN ('h1', 'h2')")).select("node_id")


@query("leader_may_act", "manifests", "SELECT namespace, generation * 100 AS elected_ms, 1000 - generation * 100 >= 150 AS may_act FROM manifests")
def leader_may_act(b):
    return b.manifests.select("namespace", (F.col("generation") * 100).alias("elected_ms"), (F.lit(1000) - F.col("generation") * 100 >= 150).alias("may_act"))


@query("dashboard", "samples", "SELECT instance, metric, arg_max(gauge, ts_ms * 1000 + series) AS value FROM samples WHERE instance IN (1, 3) GROUP BY ALL")
def dashboard(b, instances=(1, 3)):
    """A panel with the dashboard's variable for the instances."""
    return b.samples.filter(F.col("instance").isin(*instances)).groupBy("instance", "metric").agg(F.max_by("gauge", F.col("ts_ms") * 1000 + F.col("series")).alias("value"))


@query("units", "records", "SELECT event_id, ts_ms // 1000 AS ms, length / 1048576.0 AS mib FROM records")
def units(b):
    return b.records.select("event_id", F.expr("ts_ms DIV 1000").alias("ms"), (F.col("length") / 1048576.0).alias("mib"))


VERDICT_IN = """, a AS (SELECT r.namespace, r.file_id, r.idx, r.node_id, r.partkey, n.state IS NOT NULL AND n.state <> 'DEAD' AS live, p.state AS rs, p.length AS rl, p.crc AS rc, r.length, r.crc FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id
 LEFT JOIN reports p ON p.namespace = r.namespace AND p.file_id = r.file_id AND p.idx = r.idx AND p.node_id = r.node_id WHERE r.state = 'SEALED'),
j AS (SELECT *, (partkey + node_id) % 37 = 0 AS safe, rs = 'SEALED' AND rl = length AND rc = crc AS fine, rs = 'OPEN' AND rl >= length AS again, 1000 - (partkey * 11 + node_id) % 1000 >= 300 AS due FROM a),
d AS (SELECT *, live AND NOT safe AND fine IS NOT TRUE AND again IS NOT TRUE AS bad FROM j),
o AS (SELECT d.*, (SELECT count(*) FROM d x WHERE x.namespace = d.namespace AND x.file_id = d.file_id AND x.idx = d.idx AND x.live AND x.node_id <> d.node_id) - (SELECT count(*) FROM d x WHERE x.namespace = d.namespace AND x.file_id = d.file_id AND x.idx = d.idx AND x.bad AND x.due AND x.node_id < d.node_id) AS others FROM d)
SELECT namespace, file_id, idx, node_id, CASE WHEN NOT live THEN 'no-answer' WHEN safe THEN 'protected' WHEN fine THEN 'healthy' WHEN again THEN 'reseal' WHEN others <= 0 THEN 'keep-last-live' WHEN NOT due THEN 'in-grace' WHEN rs IS NULL THEN 'drop-missing' WHEN rs <> 'SEALED' THEN 'drop-not-sealed' ELSE 'drop-corrupt' END AS verdict FROM o"""


@query("replica_verdicts", "replicas reports nodes", VERDICT_IN)
def replica_verdicts(b):
    since = b.replicas.selectExpr(*CHUNK, "node_id", "(partkey * 11 + node_id) % 1000 AS since_ms")
    return H.verdicts(b.replicas, b.reports, b.nodes, 1000, 300, since, b.replicas.filter("(partkey + node_id) % 37 = 0"))
