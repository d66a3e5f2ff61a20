"""Scalar functions of the log's data model, as column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Error codes and whether a caller may retry.
ERROR_CODES = {
    "OK": False, "UNKNOWN_OPCODE": False, "UNSUPPORTED_VERSION": False, "FENCED_EPOCH": False, "OFFSET_GAP": True, "CHUNK_NOT_FOUND": False, "CHUNK_SEALED": False,
    "CHUNK_ALREADY_EXISTS": False, "OUT_OF_SPACE": False, "CRC_MISMATCH": False, "NOT_REGISTERED": False, "LEASE_EXPIRED": False, "THROTTLED": True, "CORRUPT_CHUNK": False,
    "INTERNAL": True, "NOT_LEADER": True, "NO_CAPACITY": True, "FILE_NOT_FOUND": False, "FILE_SEALED": False, "PRECONDITION_FAILED": False,
}


def file_id_hex(x: Column) -> Column:
    """Sixteen lower-case hex digits of an unsigned id."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def file_id_from_hex(x: Column) -> Column:
    return F.conv(x, 16, -10).cast("bigint")


def unsigned_order(x: Column) -> Column:
    """A sort key under which ids compare as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def shard_path(namespace: Column, file_id: Column, idx: Column) -> Column:
    """namespace / low byte / second byte / id.index of a chunk."""
    byte = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    return F.concat_ws("/", namespace, byte(file_id.bitwiseAND(255)), byte(F.shiftright(file_id, 8).bitwiseAND(255)), F.concat(file_id_hex(file_id), F.lit("."), idx.cast("string")))


def base_name(x: Column) -> Column:
    """Index after the last dot; null without one or if it is no number."""
    return F.when(F.instr(x, ".") > 0, F.substring_index(x, ".", -1).try_cast("bigint"))


def valid_namespace(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9._-]{1,255}$") & ~x.isin(".", "..") & ~x.startswith("__")


def valid_path(x: Column) -> Column:
    """Absolute and canonical, at most 1024 bytes and 64 segments of at most 255 bytes of letters, digits, dot, underscore and
    hyphen; one name is reserved."""
    parts = F.slice(F.split(x, "/"), 2, 2000)
    return (
        x.startswith("/") & (F.length(x) > 1) & (F.octet_length(x) <= 1024) & (F.size(parts) <= 64)
        & F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9._-]{1,255}$") & ~p.isin(".", "..", "__file"))
    )


def valid_policy(replicas: Column, quorum: Column) -> Column:
    return (quorum > 0) & (quorum <= replicas) & (quorum > F.floor(replicas / 2))


def backoff(base_ms: int, attempt: Column, cap_ms: int, seed: Column) -> Column:
    """Exponential backoff with up to a tenth of jitter from a digest of the seed, never beyond the cap."""
    wait = F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)).cast("bigint")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), attempt.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.least(F.lit(cap_ms).cast("bigint"), wait + F.pmod(draw, F.expr("1L") + F.floor(wait / 10)))


def retriable(spark: SparkSession, codes: DataFrame, code: str) -> DataFrame:
    """codes with whether each may be retried; an unknown one counts as INTERNAL."""
    known = spark.createDataFrame(pd.DataFrame({code: list(ERROR_CODES), "retriable": list(ERROR_CODES.values())}))
    return codes.join(F.broadcast(known), code, "left").withColumn("retriable", F.coalesce("retriable", F.lit(True)))


def parse_bounds(x: Column) -> Column:
    """Bucket bounds of a comma-separated list; null unless they are positive and increase strictly."""
    a = F.transform(F.split(x, ","), lambda p: F.trim(p).try_cast("double"))
    ok = F.forall(a, lambda v: v.isNotNull() & (v > 0)) & F.forall(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.element_at(a, i) > F.element_at(a, F.greatest(i - 1, F.lit(1)))))
    return F.when(ok, a)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc32c_many(values: list[bytes | None]) -> np.ndarray:
    """Castagnoli checksums of byte strings, all rows advanced together one byte at a time, the longest first."""
    order = np.argsort([-len(v or b"") for v in values], kind="stable")
    lens = np.array([len(values[i] or b"") for i in order], dtype=np.int64)
    data = np.frombuffer(b"".join(values[i] or b"" for i in order), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
    crc = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    live = len(lens)
    for j in range(int(lens[0]) if len(lens) else 0):
        while live and lens[live - 1] <= j:
            live -= 1
        part = crc[:live]
        crc[:live] = _TABLE[(part ^ data[starts[:live] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def with_crc32c(df: DataFrame, payload: str, out: str = "crc") -> DataFrame:
    """df with the CRC32C of a binary column; null has none. One Arrow pass, no shuffle."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != out]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            values = batch.column(at(payload)).to_pylist()
            crc = pa.array(crc32c_many(values), mask=np.array([v is None for v in values]))
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in keep] + [crc], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep) + f", `{out}` bigint"
    return df.mapInArrow(run, schema)


def range_checksums(df: DataFrame, key: list[str], payload: str, size: int) -> DataFrame:
    """CRC32C of every range of ``size`` bytes of a payload: (key, range, crc)."""
    n = F.ceil(F.length(payload) / size).cast("int")
    parts = df.select(*key, payload, F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("range"))
    return with_crc32c(parts.select(*key, "range", F.expr(f"substring({payload}, range * {size} + 1, {size})").alias("part")), "part").drop("part")


def encode_varint(value: int) -> bytes:
    """Unsigned LEB128."""
    if value < 0:
        raise ValueError("varints are unsigned")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_varints(data: bytes) -> list[int]:
    """All varints of a buffer; an unfinished or too long one is an error."""
    out, value, shift = [], 0, 0
    for b in data:
        if shift > 63:
            raise ValueError("varint too long")
        value |= (b & 0x7F) << shift
        if b & 0x80:
            shift += 7
        else:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("unfinished varint")
    return out
