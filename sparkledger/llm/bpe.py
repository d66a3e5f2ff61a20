"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is one pre-token.  Its adjacent pairs wait in
buckets, one per merge rank, that hold positions of a linked list.  A bitmap of
three levels marks the ranks whose bucket holds something; find-first-set picks
the next rank, the leftmost position of its bucket comes first, and entries
whose pair has changed since are skipped.  A pre-token of n bytes takes
O(n log n), so one of a megabyte is no special case.

Null text encodes as empty text (no ids); repeated rows give repeated results;
an empty table gives an empty table; columns besides the named ones pass
through, and an existing column of the output's name is replaced.  Ids outside
the vocabulary raise IndexError or TypeError on decoding; null ids decode to empty bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import struct
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches, table

#: Pre-tokens whose ids a worker remembers; beyond that it forgets all and starts anew.
CACHE_ENTRIES = 700_000
#: Text gathered before its unseen pre-tokens go through the queue together.
GATHER_CHARS = 4 << 20
#: Longer pre-tokens go through a queue of their own.
LONE_BYTES = 256
#: The split pattern of the vocabulary files, for which the standard library has an equal and faster form ...
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def rare():
    """... on texts without these: numbers that are no decimal digits, and controls that only the library calls space."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Nl", "No") or 0x1C <= c <= 0x1F:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search


class RankQueue:
    """Buckets by rank, under a bitmap of three levels of 64."""

    def __init__(self, n_ranks: int):
        self.leaf = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.leaf[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        return found

    def first(self) -> int:
        """The lowest rank whose bucket holds something, -1 for none: three times find-first-set."""
        top = self.top
        if not top:
            return -1
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.leaf[b]
        return (b << 6) + (word & -word).bit_length() - 1

    def clear(self, rank: int) -> list:
        """Take the bucket of a rank out."""
        b, a = rank >> 6, rank >> 12
        self.leaf[b] &= ~(1 << (rank & 63))
        if not self.leaf[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return self.buckets.pop(rank)


class ByteBpe:
    """One vocabulary of ranks with its split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.top = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.find, self.fast = regex.compile(pattern).findall, pattern == KNOWN_PATTERN
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():  # every way to put the token together counts, not only the one it was learnt by
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 21 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.pieces: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges to, -1 for none."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        queue, n, get = RankQueue(self.top), len(piece), ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts here, -1 for none
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.bucket(r).append(i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.clear(rank)
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            before[end] = i
            pair[j] = -1
            for at, r in ((i, get(piece[i : after[end]], -1) if end < n else -1), *(((h := before[i]), get(piece[h:end], -1)) for _ in range(i > 0))):
                if pair[at] != r:
                    pair[at] = r
                    if r >= 0:
                        heapq.heappush(queue.bucket(r), at)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens: one queue holds the positions of all, and each pop merges in every
        pre-token that waits at that rank its leftmost pair, so each goes through the very steps it would take alone."""
        lens = np.array([len(x) for x in pieces], dtype=np.int64)
        n = int(lens.sum())
        ids = np.append(self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)], self.top)
        ends = np.cumsum(lens)
        piece = np.repeat(np.arange(len(pieces)), lens)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[ends - lens] = n  # no neighbour: the spare slot, whose id pairs with nothing
        alive = np.ones(n, dtype=bool)
        pair = np.append(self.pair_ranks(ids[:n], ids[after[:n]]), -1)
        queue = RankQueue(self.top)

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            some = ranks >= 0
            ranks, positions = ranks[some], positions[some]
            if len(ranks):
                order = np.argsort(ranks, kind="stable")
                ranks, positions = ranks[order], positions[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                    queue.bucket(r).append(part)

        push(pair[:n], np.arange(n))
        while (rank := queue.first()) >= 0:
            parts = queue.clear(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            own = piece[at]
            leftmost = np.append(True, own[1:] != own[:-1])
            if not leftmost.all():
                queue.bucket(rank).append(at[~leftmost])
                at = at[leftmost]
            gone = after[at]
            end, front = after[gone], before[at]
            after[at] = end
            before[end] = at
            ids[at] = rank
            alive[gone] = False
            pair[gone] = -1
            merged = np.full(len(at), rank)
            new = np.concatenate((self.pair_ranks(merged, ids[end]), self.pair_ranks(ids[front], merged)))
            where = np.concatenate((at, front))
            pair[where] = new
            pair[n] = -1
            push(np.where(where < n, new, -1), where)
        packed = ids[:n][alive].astype("<u4").tobytes()
        cut = np.concatenate(([0], np.cumsum(np.add.reduceat(alive, ends - lens, dtype=np.int64)))) * 4
        return [packed[a:b] for a, b in itertools.pairwise(cut.tolist())]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        return FAST.findall(text) if self.fast and (text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text or not rare()(text)) else self.find(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        split, pieces = [self.split(x) for x in texts], self.pieces
        new = {x: x.encode() for x in set().union(*split).difference(pieces)}
        short = [x for x, raw in new.items() if len(raw) <= LONE_BYTES and raw not in self.ranks]
        if short:
            pieces.update(zip(short, self.merge_many([new[x] for x in short]), strict=True))
        for x, raw in new.items():
            if x not in pieces:
                ids = self.merge(raw)
                pieces[x] = struct.pack(f"<{len(ids)}I", *ids)
        out = [b"".join(map(pieces.__getitem__, x)) for x in split]
        for x in [x for x in new if len(x) > 64]:
            del pieces[x]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text or ""])[0], dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids or ()])


def gathered(texts: list[str | None]):
    """Ranges of texts of so many characters together, or one text."""
    a, total = 0, 0
    for i, x in enumerate(texts):
        total += len(x or "")
        if total > GATHER_CHARS:
            yield a, i + 1
            a, total = i + 1, 0
    yield a, len(texts)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """A worker reads a vocabulary once; the file lies with the Python installation of every machine."""
    return ByteBpe(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _mapped(df: DataFrame, make, fields: dict[str, tuple[T.DataType, pa.DataType]]) -> DataFrame:
    """df with columns computed by make(batch) -> arrays; they replace columns of the same names."""
    keep = [c for c in df.columns if c.lower() not in fields]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(k, v[0]) for k, v in fields.items()])

    def run(batches):
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, type=t) for x, (_, t) in zip(make(batch), fields.values(), strict=True)], names=keep + list(fields))

    small_batches(df.sparkSession, 1024)
    return df.mapInArrow(run, schema)


def _texts(batch, text: str):
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of its text as array<bigint>."""

    def make(batch):
        texts, bpe = _texts(batch, text), load(path, pattern)
        return [[np.frombuffer(x, dtype="<u4").astype(np.int64) for a, b in gathered(texts) for x in bpe.encode_all([t or "" for t in texts[a:b]])]]

    return _mapped(df, make, {out: (T.ArrayType(T.LongType()), pa.list_(pa.int64()))})


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    return _mapped(df, lambda b: [[load(path, pattern).decode(x) for x in _texts(b, ids)]], {out: (T.BinaryType(), pa.binary())})


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens and the digests of its ids and of the bytes decoded from them, in one pass without shipping the ids."""

    def make(batch):
        bpe, texts, n, ids, back = load(path, pattern), _texts(batch, text), [], [], []
        for a, b in gathered(texts):
            for packed in bpe.encode_all([t or "" for t in texts[a:b]]):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, dtype="<u4").tolist())).hexdigest())
        return n, ids, back

    return _mapped(df, make, {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())})


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_vocabulary())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
SQL: dict[str, str] = {}
