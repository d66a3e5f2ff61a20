"""Queries over scalar functions, integrity, sources and streams."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..sources import files as R
from ..streaming import jobs as J
from .registry import QUERIES, SQL, query


@query("file_id_hex", "files", "SELECT file_id, lpad(lower(to_hex(file_id * 4294967291)), 16, '0') AS hex, file_id * 4294967291 AS back FROM files")
def file_id_hex(b):
    h = X.file_id_hex(F.col("file_id") * 4294967291)
    return b.files.select("file_id", h.alias("hex"), X.file_id_from_hex(h).alias("back"))


@query("shard_paths", "chunks", "SELECT namespace, file_id, idx, namespace || '/' || lpad(lower(to_hex(file_id % 256)), 2, '0') || '/' || lpad(lower(to_hex((file_id // 256) % 256)), 2, '0') || '/' || lpad(lower(to_hex(file_id)), 16, '0') || '.' || idx AS path, idx AS parsed FROM chunks")
def shard_paths(b):
    p = X.shard_path(F.col("namespace"), F.col("file_id"), F.col("idx"))
    return b.chunks.select("namespace", "file_id", "idx", p.alias("path"), X.base_name(p).alias("parsed"))


NAMES = "CASE file_id % 6 WHEN 0 THEN '..' WHEN 1 THEN '__x' WHEN 2 THEN 'a b' WHEN 3 THEN '' ELSE namespace END"
PATHS = "CASE file_id % 7 WHEN 0 THEN path || '/' WHEN 1 THEN 'x' || path WHEN 2 THEN path || '/../y' WHEN 3 THEN path || '/a b' WHEN 4 THEN '/__files' || path WHEN 5 THEN '/__file/' || path ELSE path END"


@query("valid_names", "files", f", n AS (SELECT file_id, {NAMES} AS name, {PATHS} AS p FROM files) SELECT file_id, regexp_full_match(name, '[A-Za-z0-9._-]{{1,255}}') AND name NOT IN ('.', '..') AND NOT starts_with(name, '__') AS name_ok, file_id % 7 IN (4, 6) AS path_ok FROM n")
def valid_names(b):
    at = b.files.select("file_id", F.expr(NAMES).alias("name"), F.expr(PATHS).alias("p"))
    return at.select("file_id", X.valid_namespace(F.col("name")).alias("name_ok"), X.valid_path(F.col("p")).alias("path_ok"))


@query("valid_policies", "", "SELECT p_partkey, p_size % 6 AS rf, p_partkey % 5 AS q, p_partkey % 5 > 0 AND p_partkey % 5 <= p_size % 6 AND p_partkey % 5 > (p_size % 6) // 2 AS ok FROM part")
def valid_policies(b):
    at = b.part.selectExpr("p_partkey", "p_size % 6 AS rf", "p_partkey % 5 AS q")
    return at.withColumn("ok", X.valid_policy(F.col("rf"), F.col("q")))


CODE = "CASE event_id % 9 WHEN 0 THEN 'THROTTLED' WHEN 1 THEN 'FENCED_EPOCH' WHEN 2 THEN 'NEW_CODE' WHEN 3 THEN 'OK' WHEN 4 THEN 'NOT_LEADER' WHEN 5 THEN 'CRC_MISMATCH' WHEN 6 THEN 'OFFSET_GAP' WHEN 7 THEN 'NO_CAPACITY' ELSE 'LEASE_EXPIRED' END"


@query("retriable_codes", "records", f"SELECT {CODE} AS code, {CODE} IN ('THROTTLED', 'NEW_CODE', 'NOT_LEADER', 'OFFSET_GAP', 'NO_CAPACITY') AS retriable, count(*) AS n FROM records GROUP BY ALL")
def retriable_codes(b):
    return X.retriable(b.spark, b.records.select(F.expr(CODE).alias("code")), "code").groupBy("code", "retriable").agg(F.count("*").alias("n"))


@query("backoff_delays", "", """WITH w AS (SELECT event_id, CAST(least(5000, 20 * pow(2, event_id % 12)) AS BIGINT) AS wait, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':' || CAST(event_id % 12 AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM events)
SELECT event_id, least(5000, wait + draw % (1 + wait // 10)) AS wait_ms FROM w""")
def backoff_delays(b):
    return b.events.select("event_id", X.backoff(20, F.col("event_id") % 12, 5000, F.col("event_id")).alias("wait_ms"))


BOUNDS = "CASE p_partkey % 4 WHEN 0 THEN '1,5,10' WHEN 1 THEN '5,1' WHEN 2 THEN '1,x' ELSE '0,1' END"


@query("bucket_bounds", "", f"SELECT p_partkey, {BOUNDS} AS text, p_partkey % 4 = 0 AS ok FROM part")
def bucket_bounds(b):
    return b.part.select("p_partkey", F.expr(BOUNDS).alias("text"), X.parse_bounds(F.expr(BOUNDS)).isNotNull().alias("ok"))


@query("payload_crc32c")
def payload_crc32c(b):
    return X.with_crc32c(b.records.select("event_id", F.encode("payload", "UTF-8").alias("payload")), "payload").select("event_id", "crc")


@query("range_checksums")
def range_checksums(b):
    return X.range_checksums(b.documents.select("doc_id", F.encode("text", "UTF-8").alias("body")), ["doc_id"], "body", 4096)


@query("scrub", "records", "SELECT namespace, count(*) FILTER (WHERE event_id % 31 = 0) AS rotten, count(*) AS scanned FROM records GROUP BY namespace")
def scrub(b):
    """Recomputed digests against stored ones, of which some were spoilt."""
    stored = b.records.select("event_id", F.expr("CASE WHEN event_id % 31 = 0 THEN sha2(concat(payload, '!'), 256) ELSE sha2(payload, 256) END").alias("stored"))
    at = b.records.join(stored, "event_id")
    return at.groupBy("namespace").agg(F.count_if(F.sha2("payload", 256) != F.col("stored")).alias("rotten"), F.count("*").alias("scanned"))


@query("ack_evidence", "records", "SELECT namespace, file_id, CAST(sum(length) AS BIGINT) AS n_bytes, sha256(string_agg(payload, '' ORDER BY seq)) AS digest FROM records GROUP BY ALL")
def ack_evidence(b):
    """Bytes and digest of a file's acknowledged prefix; a file is bounded, so its payloads may come together."""
    per = b.records.groupBy("namespace", "file_id").agg(F.sum("length").alias("n_bytes"), F.expr("array_join(transform(sort_array(collect_list(struct(seq, payload))), x -> x.payload), '')").alias("whole"))
    return per.select("namespace", "file_id", "n_bytes", F.sha2("whole", 256).alias("digest"))


@query("exposition", "samples", "SELECT metric, CAST(instance AS VARCHAR) AS instance, count(*) AS n, CAST(sum(gauge) AS DOUBLE) AS total FROM samples WHERE gauge % 7 <> 0 GROUP BY ALL")
def exposition(b):
    text = b.samples.selectExpr("""CASE WHEN gauge % 7 = 0 THEN '# HELP x' ELSE concat(metric, '{instance="', instance, '",series="', series, '"} ', gauge) END AS value""")
    return R.parse_exposition(text).groupBy("metric", F.col("labels")["instance"].alias("instance")).agg(F.count("*").alias("n"), F.sum("sample").alias("total"))


EVENTS = "SELECT event_type AS namespace, user_id AS file_id, event_id, CAST(length(props) AS BIGINT) AS length, 1 + CAST(floor(event_id / 4000) AS BIGINT) AS epoch, event_id % 29 = 0 AS fence FROM events"
QUERIES["stream_append_machine"] = J.append_machine
SQL["stream_append_machine"] = f"""WITH a AS ({EVENTS}), f AS (SELECT *, coalesce(max(CASE WHEN fence THEN epoch + 1 ELSE 0 END) OVER (PARTITION BY namespace, file_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fenced FROM a)
SELECT namespace, file_id, event_id, epoch >= fenced AS accepted, CASE WHEN epoch >= fenced THEN 'OK' ELSE 'FENCED_EPOCH' END AS reason, CAST(sum(CASE WHEN epoch >= fenced THEN length ELSE 0 END) OVER (PARTITION BY namespace, file_id ORDER BY event_id) AS BIGINT) AS end_offset FROM f"""
QUERIES["stream_latest_leases"] = J.latest_leases
SQL["stream_latest_leases"] = "SELECT user_id AS node_id, max(event_id * 250) AS ts_ms, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS free_bytes FROM events GROUP BY user_id"
QUERIES["stream_first_operations"] = J.first_operations
SQL["stream_first_operations"] = "SELECT DISTINCT event_type AS namespace, user_id AS op FROM events"
QUERIES["stream_throughput"] = J.windowed_throughput
SQL["stream_throughput"] = "SELECT event_type AS namespace, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(sum(length(props)) AS BIGINT) AS bytes, count(*) AS ops FROM events GROUP BY ALL"
