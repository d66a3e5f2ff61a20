"""Queries over replica health, placement and garbage collection."""

from pyspark.sql import functions as F

from ..operators import gc as G
from ..operators import health as H
from ..operators import placement as P
from ..operators.votes import CHUNK
from .registry import query

STATE = "coalesce(n.state, 'DEAD')"
ON = "{0}.namespace = {1}.namespace AND {0}.file_id = {1}.file_id AND {0}.idx = {1}.idx"


@query("replica_endpoints", "replicas nodes", f"SELECT r.namespace, r.file_id, r.idx, r.node_id, n.endpoint, n.host, {STATE} AS node_state FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id")
def replica_endpoints(b):
    return H.with_nodes(b.replicas, b.nodes).select(*CHUNK, "node_id", "endpoint", "host", "node_state")


@query("node_liveness", "nodes", """, l AS (SELECT CASE WHEN state = 'DEAD' THEN 'dead' WHEN state <> 'REGISTERED' THEN 'none' WHEN lease_until_ms >= 400 THEN 'alive' WHEN lease_until_ms + 200 >= 400 THEN 'suspect' ELSE 'dead' END AS liveness FROM nodes)
SELECT liveness, count(*) AS n FROM l GROUP BY liveness""")
def node_liveness(b):
    return H.liveness(b.nodes, 400, 200).groupBy("liveness").agg(F.count("*").alias("n"))


CENSUS = f""", c AS (SELECT r.namespace, r.file_id, r.idx, count(*) FILTER (WHERE {STATE} <> 'DEAD') AS live, count(*) AS members FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id GROUP BY r.namespace, r.file_id, r.idx)"""


@query("durability_census", "replicas nodes", CENSUS + " SELECT *, CASE WHEN live = 0 THEN 'unavailable' WHEN live < 3 AND live = 1 THEN 'at_min' WHEN live < 3 THEN 'under' ELSE 'full' END AS class FROM c")
def durability_census(b):
    return H.census(b.replicas, b.nodes, 3)


@query("census_by_namespace", "replicas nodes", CENSUS + " SELECT namespace, count(*) FILTER (WHERE live = 0) AS unavailable, count(*) FILTER (WHERE live < 3) AS under_replicated, count(*) FILTER (WHERE live = 1) AS at_min FROM c GROUP BY namespace")
def census_by_namespace(b):
    return H.census(b.replicas, b.nodes, 3).groupBy("namespace").agg(F.count_if(F.col("live") == 0).alias("unavailable"), F.count_if(F.col("live") < 3).alias("under_replicated"), F.count_if(F.col("live") == 1).alias("at_min"))


@query("chunks_on_dead_nodes", "replicas nodes", "SELECT DISTINCT r.namespace, r.file_id, r.idx FROM replicas r JOIN nodes n ON n.node_id = r.node_id WHERE n.state = 'DEAD'")
def chunks_on_dead_nodes(b):
    return b.replicas.join(b.nodes.filter("state = 'DEAD'"), "node_id", "left_semi").select(*CHUNK).distinct()


REPORTED = ", a AS (SELECT r.*, p.state AS rs, p.length AS rl, p.crc AS rc FROM replicas r LEFT JOIN reports p ON " + ON.format("p", "r") + " AND p.node_id = r.node_id WHERE r.state = 'SEALED')"


@query("readable_replicas", "replicas reports", REPORTED + " SELECT namespace, file_id, idx, count(*) FILTER (WHERE rs = 'SEALED' AND rl = length AND rc = crc) AS readable, count(*) AS members, count(*) FILTER (WHERE rs = 'SEALED' AND rl = length AND rc = crc) >= 2 AS quorum, count(*) FILTER (WHERE rs = 'SEALED' AND rl = length AND rc = crc) = count(*) AS \"full\" FROM a GROUP BY namespace, file_id, idx")
def readable_replicas(b):
    return H.readable(b.replicas, b.reports, 2)


@query("repair_plan", "replicas nodes", f""", c AS (SELECT r.namespace, r.file_id, r.idx, count(*) FILTER (WHERE {STATE} <> 'DEAD') AS live, count(*) AS members, min(r.node_id) FILTER (WHERE {STATE} = 'DEAD') AS dead_node, min(r.node_id) FILTER (WHERE {STATE} <> 'DEAD') AS source_node
 FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id GROUP BY r.namespace, r.file_id, r.idx) SELECT *, CASE WHEN dead_node IS NOT NULL THEN 'SWAP' ELSE 'ADD' END AS action FROM c WHERE live > 0 AND (live < members OR members < 3)""")
def repair_plan(b):
    return H.repair_candidates(b.replicas, b.nodes, 3)


@query("repair_order", "replicas nodes", CENSUS + ", o AS (SELECT namespace, file_id, idx, live, row_number() OVER (PARTITION BY namespace ORDER BY live, file_id, idx) AS rank FROM c WHERE live > 0 AND live < 3) SELECT * FROM o WHERE rank <= 10")
def repair_order(b):
    todo = H.census(b.replicas, b.nodes, 3).filter("live > 0 AND live < 3")
    return P.first_per_key(todo, "namespace", ["live", "file_id", "idx"], 10).select(*CHUNK, "live", "rank")


@query("file_violations", "files chunks", """, x AS (SELECT namespace, file_id, idx, state FROM chunks WHERE (file_id + idx) % 23 <> 0), w AS (SELECT x.*, row_number() OVER (PARTITION BY x.namespace, x.file_id ORDER BY idx) - 1 AS place, lead(idx) OVER (PARTITION BY x.namespace, x.file_id ORDER BY idx) AS nx FROM x JOIN files f ON f.file_id = x.file_id AND f.state <> 'DELETED')
SELECT namespace, file_id, idx, CASE WHEN idx <> place THEN 'gap' ELSE 'open-inside' END AS reason FROM w WHERE idx <> place OR (state = 'OPEN' AND nx IS NOT NULL)""")
def file_violations(b):
    return H.file_violations(b.files, b.chunks.filter("(file_id + idx) % 23 <> 0"))


@query("bad_replica_sets", "replicas", "SELECT namespace, file_id, idx, count(*) AS n FROM replicas WHERE (partkey + node_id) % 5 <> 0 GROUP BY ALL HAVING count(*) <> 3")
def bad_replica_sets(b):
    return H.bad_replica_sets(b.replicas.filter("(partkey + node_id) % 5 <> 0"), 3)


@query("identical_replicas", "documents", "SELECT lang, count(*) AS copies, count(DISTINCT text) = 1 AS identical FROM documents GROUP BY lang")
def identical_replicas(b):
    return H.identical_replicas(b.documents, "lang", "text")


@query("acked_not_readable", "records acks", "SELECT a.namespace, a.file_id, a.end_offset, md5(r.payload) AS digest FROM acks a JOIN records r ON r.event_id = a.event_id WHERE a.node_id = 0 AND r.event_id % 43 = 0")
def acked_not_readable(b):
    acked = b.acks.filter("node_id = 0").join(b.records.select("event_id", F.md5("payload").alias("digest")), "event_id").select("namespace", "file_id", "end_offset", "digest")
    seen = b.records.filter("event_id % 43 <> 0").select("namespace", "file_id", "end_offset", F.md5("payload").alias("digest"))
    return H.acked_not_readable(acked, seen)


@query("delete_drive", "files replicas nodes", f""", p AS (SELECT r.namespace, r.file_id, count(*) FILTER (WHERE {STATE} <> 'DEAD') AS to_delete, count(*) FILTER (WHERE {STATE} = 'DEAD') AS implicit FROM replicas r LEFT JOIN nodes n ON n.node_id = r.node_id GROUP BY ALL),
d AS (SELECT f.namespace, f.file_id, coalesce(to_delete, 0) AS to_delete, coalesce(implicit, 0) AS implicit FROM files f LEFT JOIN p ON p.namespace = f.namespace AND p.file_id = f.file_id WHERE f.state = 'DELETING')
SELECT *, CASE WHEN to_delete + implicit = 0 THEN 'DROP_FILE' WHEN to_delete = 0 THEN 'CONFIRM' ELSE 'DELETE_REPLICAS' END AS step FROM d""")
def delete_drive(b):
    return H.delete_drive(b.files, b.replicas, b.nodes)


@query("namespace_owners", "files nodes", """, s AS (SELECT namespace, endpoint, sha256(namespace || chr(0) || chr(0) || chr(0) || chr(0) || chr(3) || chr(0) || endpoint) AS h FROM (SELECT DISTINCT namespace FROM files) f CROSS JOIN (SELECT DISTINCT endpoint FROM nodes) n),
k AS (SELECT *, CASE WHEN h >= '8' THEN CAST(('0x' || substr(h, 1, 16))::UHUGEINT::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(('0x' || substr(h, 1, 16))::HUGEINT AS BIGINT) END AS score FROM s),
r AS (SELECT namespace, endpoint, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, endpoint) AS rank FROM k) SELECT * FROM r WHERE rank <= 3""")
def namespace_owners(b):
    return P.owners(b.files, b.nodes, 3, 3)


@query("eligible_nodes", "nodes", "SELECT node_id, host, free_bytes FROM nodes WHERE state = 'REGISTERED' AND lease_until_ms + 200 >= 400 AND free_bytes > 0")
def eligible_nodes(b):
    return P.eligible(b.nodes, 400, 200).select("node_id", "host", "free_bytes")


@query("placement")
def placement(b):
    requests = b.files.filter("state = 'OPEN'").select(F.col("file_id").alias("request"))
    return P.place(requests, P.eligible(b.nodes, 0, 200), 3, 17)


@query("round_robin", "files", "SELECT namespace, file_id, (row_number() OVER (PARTITION BY namespace ORDER BY file_id) - 1) % 3 AS slot FROM files")
def round_robin(b):
    return P.round_robin(b.files, ["namespace"], "file_id", 3).select("namespace", "file_id", "slot")


@query("commands_per_heartbeat", "replicas", ", k AS (SELECT namespace, file_id, idx, node_id, row_number() OVER (PARTITION BY node_id ORDER BY namespace, file_id, idx) AS rank FROM replicas) SELECT * FROM k WHERE rank <= 4")
def commands_per_heartbeat(b):
    return P.first_per_key(b.replicas.select(*CHUNK, "node_id"), "node_id", CHUNK, 4)


VERDICT = ", o AS (SELECT r.namespace, r.file_id, r.idx, r.node_id, CASE WHEN r.namespace = 'ns4' THEN 'UNREACHABLE' WHEN (r.partkey + r.node_id) % 6 <> 0 THEN 'KEEP' ELSE 'ORPHAN' END AS verdict FROM reports p JOIN replicas r ON " + ON.format("p", "r") + " AND p.node_id = r.node_id WHERE p.state = 'SEALED')"


def _orphans(b):
    listed = b.replicas.filter("(partkey + node_id) % 6 <> 0")
    return G.orphan_verdicts(b.reports.filter("state = 'SEALED'").select(*CHUNK, "node_id"), listed, b.files.filter("namespace <> 'ns4'"))


@query("orphan_verdicts", "replicas reports", VERDICT + " SELECT * FROM o")
def orphan_verdicts(b):
    return _orphans(b)


@query("orphan_budgets", "replicas reports", VERDICT + """, c AS (SELECT node_id, namespace, count(*) FILTER (WHERE verdict = 'ORPHAN') AS orphans, count(*) AS sealed FROM o GROUP BY ALL),
w AS (SELECT *, CAST(least(orphans, 6, CASE WHEN sealed <= 0 THEN 0 ELSE greatest(1, floor(sealed * 10 / 100)) END) AS BIGINT) AS want FROM c)
SELECT *, CAST(greatest(0, least(want, 9 - coalesce(sum(want) OVER (PARTITION BY node_id ORDER BY namespace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allowed FROM w""")
def orphan_budgets(b):
    counts = _orphans(b).groupBy("node_id", "namespace").agg(F.count_if(F.col("verdict") == "ORPHAN").alias("orphans"), F.count("*").alias("sealed"))
    return G.budgets(counts, 6, 10, 9)


SYSTEM = """, p AS (SELECT file_id, created_ms, split_part(path, '/', 3) AS namespace, CAST(substr(split_part(path, '/', 4), 5) AS BIGINT) AS generation FROM system_files WHERE path NOT LIKE '/metadata-log/gen-7/%')"""


@query("system_file_paths", "system_files", ", q AS (SELECT file_id, path LIKE '/metadata-log/gen-7/%' AS odd, path FROM system_files) SELECT file_id, CASE WHEN NOT odd THEN split_part(path, '/', 3) END AS p_namespace, CASE WHEN NOT odd THEN CAST(substr(split_part(path, '/', 4), 5) AS BIGINT) END AS p_generation, CASE WHEN NOT odd THEN split_part(split_part(path, '/', 5), '-', 1) END AS p_kind FROM q")
def system_file_paths(b):
    return G.parse_system_path(b.system_files).select("file_id", "p_namespace", "p_generation", "p_kind")


@query("superseded_system_files", "system_files manifests", SYSTEM + """, n AS (SELECT namespace, generation - 1 AS generation, min(created_ms) AS born FROM p GROUP BY ALL)
SELECT p.file_id, p.namespace, p.generation FROM p JOIN manifests m ON m.namespace = p.namespace AND p.generation <= m.generation JOIN n ON n.namespace = p.namespace AND n.generation = p.generation
WHERE born + 100 <= 5000 AND p.file_id NOT IN (SELECT log_file_id FROM manifests UNION ALL SELECT snapshot_file_id FROM manifests)""")
def superseded_system_files(b):
    return G.superseded_system_files(b.system_files, b.manifests, 5000, 100)


@query("expired_tombstones", "files", "SELECT namespace, file_id, deleted_ms FROM files WHERE state = 'DELETED' AND deleted_ms <= (SELECT max(deleted_ms) - 100000 FROM files)")
def expired_tombstones(b):
    cutoff = b.files.agg(F.max("deleted_ms") - 100000).scalar()
    return G.expired_tombstones(b.files, cutoff).select("namespace", "file_id", "deleted_ms")


LOCAL = "SELECT namespace, file_id, idx, node_id, state, (partkey * 13 + node_id) % 1000 AS protected_until_ms, (partkey * 7 + node_id) % 1000 AS last_verified_ms FROM replicas"


@query("orphan_suspects", "replicas", f", l AS ({LOCAL}) SELECT namespace, file_id, idx, node_id FROM l WHERE state = 'SEALED' AND 600 >= protected_until_ms AND 600 - last_verified_ms >= 100")
def orphan_suspects(b):
    local = b.replicas.selectExpr(*CHUNK, "node_id", "state", "(partkey * 13 + node_id) % 1000 AS protected_until_ms", "(partkey * 7 + node_id) % 1000 AS last_verified_ms")
    return G.protected_suspects(local, 600, 100).select(*CHUNK, "node_id")


@query("timed_out_commands", "files", "SELECT file_id AS command_id, created_ms AS issued_ms FROM files WHERE file_id % 3 <> 0 AND (SELECT max(created_ms) FROM files) - created_ms > 50000")
def timed_out_commands(b):
    issued = b.files.selectExpr("file_id AS command_id", "created_ms AS issued_ms")
    return G.timed_out(issued, issued.filter("command_id % 3 = 0"), issued.agg(F.max("issued_ms")).scalar(), 50000)
