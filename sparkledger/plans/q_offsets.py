"""Queries over offsets, prefixes and votes."""

from pyspark.sql import functions as F

from ..operators import offsets as O
from ..operators import prefix as P
from ..operators import votes as V
from .registry import query

DURABLE = """, e AS (SELECT namespace, file_id, node_id, max(end_offset) AS acked FROM acks GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace, file_id ORDER BY acked DESC, node_id) AS k FROM e),
d AS (SELECT namespace, file_id, coalesce(max(acked) FILTER (WHERE k = 2), 0) AS durable_offset, max(acked) AS local_end FROM r GROUP BY ALL)"""


@query("durable_offset", "records acks", DURABLE + """
SELECT d.namespace, d.file_id, durable_offset, local_end, written - durable_offset AS lag
FROM d JOIN (SELECT namespace, file_id, max(end_offset) AS written FROM records GROUP BY ALL) w ON w.namespace = d.namespace AND w.file_id = d.file_id""")
def durable_offset(b):
    written = b.records.groupBy(*O.KEY).agg(F.max("end_offset").alias("written"))
    return O.quorum_offsets(b.acks, 2).join(written, O.KEY).select(*O.KEY, "durable_offset", "local_end", (F.col("written") - F.col("durable_offset")).alias("lag"))


@query("visible_records", "records acks", DURABLE + " SELECT r.namespace, r.file_id, r.seq, r.end_offset FROM records r JOIN d ON r.namespace = d.namespace AND r.file_id = d.file_id WHERE r.end_offset <= least(durable_offset, local_end)")
def visible_records(b):
    return O.visible(b.records, O.quorum_offsets(b.acks, 2)).select(*O.KEY, "seq", "end_offset")


@query("recovery_tail", "records acks", DURABLE + " SELECT r.namespace, r.file_id, count(*) AS n_tail, max(r.end_offset) AS tail_end FROM records r JOIN d ON r.namespace = d.namespace AND r.file_id = d.file_id WHERE r.end_offset > durable_offset GROUP BY ALL")
def recovery_tail(b):
    return b.records.join(O.quorum_offsets(b.acks, 2), O.KEY).filter("end_offset > durable_offset").groupBy(*O.KEY).agg(F.count("*").alias("n_tail"), F.max("end_offset").alias("tail_end"))


@query("record_bases", "records", "SELECT namespace, file_id, seq, end_offset - length AS base_offset, end_offset FROM records")
def record_bases(b):
    return O.with_base_offsets(b.records).select(*O.KEY, "seq", "base_offset", "end_offset")


@query("chunk_bases", "chunks", "SELECT namespace, file_id, idx, length, CAST(sum(length) OVER (PARTITION BY namespace, file_id ORDER BY idx) - length AS BIGINT) AS base_offset FROM chunks")
def chunk_bases(b):
    return O.chunk_bases(b.chunks).select(*O.KEY, "idx", "length", "base_offset")


@query("entries_covering", "records", "SELECT namespace, file_id, seq FROM records WHERE end_offset > 100 AND end_offset - length < 300")
def entries_covering(b):
    return O.covering(b.records, 100, 300).select(*O.KEY, "seq")


@query("entries_after", "records", "SELECT namespace, file_id, count(*) AS n FROM records WHERE end_offset > 200 GROUP BY ALL")
def entries_after(b):
    return b.records.filter("end_offset > 200").groupBy(*O.KEY).agg(F.count("*").alias("n"))


@query("read_locate", "chunks files", """, q AS (SELECT namespace, file_id, o AS "offset" FROM files CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 30 UNION ALL SELECT 75) x),
c AS (SELECT *, sum(length) OVER (PARTITION BY namespace, file_id ORDER BY idx) AS top FROM chunks)
SELECT q.namespace, q.file_id, q."offset", c.idx, CAST(q."offset" - (top - length) AS BIGINT) AS chunk_offset, CAST(least(16, top - q."offset") AS BIGINT) AS n_bytes
FROM q JOIN c ON c.namespace = q.namespace AND c.file_id = q.file_id AND q."offset" >= top - length AND q."offset" < top""")
def read_locate(b):
    requests = b.files.select(*O.KEY, F.explode(F.array(F.lit(0), F.lit(30), F.lit(75))).alias("offset"))
    return O.locate(b.chunks, requests, 16)


@query("verified_coverage", "entries records", """, e AS (SELECT e.*, r.end_offset - r.length AS base FROM entries e JOIN records r ON r.namespace = e.namespace AND r.file_id = e.file_id AND r.seq = e.seq),
s AS (SELECT namespace, file_id, CAST(sum(least(end_offset, 300) - greatest(base, 100)) AS BIGINT) AS covered FROM e WHERE entry_ok AND end_offset > 100 AND base < 300 GROUP BY ALL)
SELECT namespace, file_id, 100 AS low, 300 AS high, covered, covered = 200 AS complete FROM s""")
def verified_coverage(b):
    requests = b.entries.select(*O.KEY).distinct().withColumns({"low": F.lit(100), "high": F.lit(300)})
    return O.overlap_coverage(b.entries, requests)


@query("append_completion", "acks", """, f AS (SELECT a.namespace, a.file_id, a.node_id, a.seq, a.end_offset, (SELECT min(x.ack_ms) FROM acks x WHERE x.namespace = a.namespace AND x.file_id = a.file_id AND x.node_id = a.node_id AND x.end_offset >= a.end_offset) AS done FROM acks a),
k AS (SELECT *, row_number() OVER (PARTITION BY namespace, file_id, seq ORDER BY done, node_id) AS r FROM f) SELECT namespace, file_id, seq, end_offset, done AS durable_ms FROM k WHERE r = 2""")
def append_completion(b):
    return O.completion_times(b.acks, 2)


@query("monotonic_durable", "acks", "SELECT namespace, file_id, seq, node_id, CAST(max(ack_ms) OVER (PARTITION BY namespace, file_id ORDER BY seq, node_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high_ms FROM acks")
def monotonic_durable(b):
    at = b.acks.withColumn("o", F.col("seq") * 3 + F.col("node_id"))
    return O.monotonic(at, "ack_ms", "o", "high_ms").select(*O.KEY, "seq", "node_id", "high_ms")


@query("chunk_rolls")
def chunk_rolls(b):
    return O.chunk_rolls(b.records, 400, 12)


@query("group_commits", "records", """, g AS (SELECT namespace, file_id, CAST(floor((seq - 1) / 8) AS BIGINT) AS batch, max(end_offset) AS target, max(ts_ms) AS force_ms, count(*) AS waiters FROM records GROUP BY ALL)
SELECT *, least(50, greatest(1, force_ms - lag(force_ms) OVER (PARTITION BY namespace, file_id ORDER BY batch))) AS gap_ms FROM g""")
def group_commits(b):
    return O.group_commits(b.records, 8)


@query("contiguity_violations", "records", ", r AS (SELECT *, lag(end_offset, 1, 0) OVER (PARTITION BY namespace, file_id ORDER BY seq) AS prev FROM (SELECT * FROM records WHERE event_id % 37 <> 0) x) SELECT namespace, file_id, seq FROM r WHERE end_offset - prev <> length")
def contiguity_violations(b):
    return O.contiguity_violations(b.records.filter("event_id % 37 <> 0")).select(*O.KEY, "seq")


@query("ledger_prefix", "entries", ", b AS (SELECT namespace, file_id, min(seq) AS bad FROM entries WHERE NOT entry_ok GROUP BY ALL) SELECT e.namespace, e.file_id, count(*) AS n, max(e.end_offset) AS prefix_end FROM entries e LEFT JOIN b ON b.namespace = e.namespace AND b.file_id = e.file_id WHERE bad IS NULL OR e.seq < bad GROUP BY ALL")
def ledger_prefix(b):
    return P.ledger_prefix(b.entries).groupBy(*O.KEY).agg(F.count("*").alias("n"), F.max("end_offset").alias("prefix_end"))


@query("crash_recovery", "entries acks", DURABLE + """, b AS (SELECT namespace, file_id, min(seq) FILTER (WHERE NOT (entry_ok AND data_present AND payload_ok)) AS bad, max(end_offset) AS claimed_end FROM entries GROUP BY ALL)
SELECT b.namespace, b.file_id, claimed_end, least(coalesce(max(d.durable_offset), 0), coalesce(max(e.end_offset), 0)) AS durable_offset, coalesce(max(e.end_offset), 0) AS verified_end, count(e.seq) AS n_entries, coalesce(max(e.end_offset), 0) < claimed_end AS truncated
FROM b LEFT JOIN entries e ON e.namespace = b.namespace AND e.file_id = b.file_id AND (bad IS NULL OR e.seq < bad) LEFT JOIN d ON d.namespace = b.namespace AND d.file_id = b.file_id GROUP BY b.namespace, b.file_id, claimed_end""")
def crash_recovery(b):
    return P.recover(b.entries, O.quorum_offsets(b.acks, 2))


@query("bounded_log_prefix", "records", ", b AS (SELECT namespace, file_id, min(seq) AS bad FROM records WHERE length > 30 GROUP BY ALL) SELECT r.namespace, r.file_id, r.seq FROM records r LEFT JOIN b ON b.namespace = r.namespace AND b.file_id = r.file_id WHERE (bad IS NULL OR r.seq < bad) AND r.seq > 2")
def bounded_log_prefix(b):
    return P.bounded_log_prefix(b.records, 30, 2).select(*O.KEY, "seq")


@query("seal_votes", "votes", """, t AS (SELECT namespace, file_id, idx, final_length, crc, count(*) AS n, min(vote_seq) AS f, string_agg(DISTINCT CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS nodes FROM (SELECT * FROM votes) v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY namespace, file_id, idx ORDER BY n DESC, f) AS r, count(*) OVER (PARTITION BY namespace, file_id, idx) AS keys, sum(n) OVER (PARTITION BY namespace, file_id, idx) AS total FROM t)
SELECT namespace, file_id, idx, final_length, crc, n, nodes, CAST(total AS BIGINT) AS total, keys > 1 AS divergent FROM k WHERE r = 1 AND n >= 2""".replace("string_agg(DISTINCT CAST(node_id AS VARCHAR), ',' ORDER BY node_id)", "array_to_string(list_sort(list(DISTINCT node_id)), ',')"))
def seal_votes(b):
    return V.seal_votes(b.votes, 2)


@query("recovery_agreement", "votes", """, t AS (SELECT namespace, file_id, idx, final_length, crc, count(*) AS n FROM votes GROUP BY ALL), p AS (SELECT namespace, file_id, idx, max(n) AS best, count(*) AS n_values, CAST(3 - sum(n) AS BIGINT) AS unheard FROM t GROUP BY ALL)
SELECT *, CASE WHEN best >= 2 THEN 'QUORUM' WHEN n_values = 1 AND best + unheard >= 2 THEN 'CREDITED' WHEN n_values > 1 THEN 'CONFLICT' ELSE 'NONE' END AS verdict FROM p""")
def recovery_agreement(b):
    return V.agreement(b.votes, 2, 3)


@query("farthest_boundary", "acks", ", h AS (SELECT namespace, file_id, end_offset, count(DISTINCT node_id) AS holders FROM acks GROUP BY ALL HAVING count(DISTINCT node_id) >= 3) SELECT namespace, file_id, max(end_offset) AS boundary, arg_max(holders, end_offset) AS holders FROM h GROUP BY ALL")
def farthest_boundary(b):
    return V.farthest_boundary(b.acks, 3, O.KEY)


@query("evict_short", "reports replicas", ", f AS (SELECT DISTINCT namespace, file_id, idx, length AS fl FROM replicas) SELECT r.namespace, r.file_id, r.idx, count(*) FILTER (WHERE r.state = 'SEALED' AND r.length < fl) AS evicted, count(*) FILTER (WHERE NOT (r.state = 'SEALED' AND r.length < fl)) AS \"left\", count(*) FILTER (WHERE NOT (r.state = 'SEALED' AND r.length < fl)) >= 2 AS recoverable FROM reports r JOIN f ON f.namespace = r.namespace AND f.file_id = r.file_id AND f.idx = r.idx GROUP BY r.namespace, r.file_id, r.idx")
def evict_short(b):
    floors = b.replicas.select(*V.CHUNK, F.col("length").alias("floor")).distinct()
    return V.evict_short(b.reports, floors, 2)


OUTCOME = "CASE WHEN (event_id * 7 + node_id) % 101 = 0 THEN 'FENCED' WHEN (event_id * 5 + node_id) % 67 = 0 THEN 'SEALED' WHEN (event_id * 3 + node_id) % 13 = 0 THEN 'ERROR' ELSE 'OK' END"


@query("append_decisions", "acks", f""", o AS (SELECT namespace, file_id, seq, count(*) FILTER (WHERE x = 'FENCED') AS fenced, count(*) FILTER (WHERE x = 'SEALED') AS sealed, count(*) FILTER (WHERE x = 'OK') AS live FROM (SELECT *, {OUTCOME} AS x FROM acks) a GROUP BY ALL)
SELECT *, CASE WHEN fenced > 0 THEN 'DIE' WHEN sealed > 0 THEN 'ROLL' WHEN live < 2 THEN 'DIE' WHEN live < 3 THEN 'FAIL_REPLICA' ELSE 'CONTINUE' END AS decision FROM o""")
def append_decisions(b):
    return V.append_decisions(b.acks.withColumn("outcome", F.expr(OUTCOME)), 2)
