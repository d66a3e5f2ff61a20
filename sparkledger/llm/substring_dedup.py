"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document; a word goes if a
window that covers it also starts in a document with a smaller doc_id.  Every
window is represented by one fingerprint, the least hash among the runs of
``GRAM`` words inside it: equal windows have equal fingerprints, and
neighbouring windows mostly share theirs.  The index keeps (fingerprint,
document) in sorted immutable runs, bucketed by fingerprint.  A new batch is
merge-joined with each run and with itself; the windows behind a shared
fingerprint are then verified by digests of their words, and runs are merged
into one when there are more than ``FAN_IN``.

Documents with the same words are collapsed first: the copies with larger ids
lose every word if they have a window at all.  Null and empty texts have no
words and keep none; a document of fewer words than a window keeps all; rows
that repeat a doc_id are one document and take nothing from each other; a row
without doc_id keeps all words; an empty table gives an empty table.  Only the
named id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, small_batches, table
from .words import slices, split_words, text_buffers

WINDOW = 13
GRAM = 5
#: Runs beyond which the index is compacted.
FAN_IN = 4
#: Batches, by ranges of doc_id, in which a whole table goes through the index.
BATCHES = 2


class Doc:
    """Words of one document, with what its windows need."""

    def __init__(self, words, i: int):
        a, b = int(words.doc_words[i]), int(words.doc_words[i + 1])
        self.n = b - a
        s, e = words.starts[a:b], words.ends[a:b]
        raw = words.data[s[0] : e[-1]].tobytes().split() if self.n else []
        self.words = raw
        self.text = b" ".join(raw)
        self.content = hashlib.blake2b(self.text, digest_size=16).digest()
        self.span = (a, b)


def documents(column: pa.Array):
    """(Doc, hashes of its runs of GRAM words) of each text."""
    raw, off = text_buffers(column)
    for x, y in slices(off):
        with np.errstate(over="ignore"):
            words = split_words(raw, off[x : y + 1])
            grams, _ = words.windows(GRAM)
        for i in range(y - x):
            doc = Doc(words, i)
            a, b = doc.span
            yield doc, grams[a : max(a, b - GRAM + 1)]


def window_prints(grams: np.ndarray) -> np.ndarray:
    """Fingerprint of each window of a document."""
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    return sliding_window_view(grams, width).min(axis=1).view(np.int64)


def _profiles(texts: DataFrame) -> DataFrame:
    """(doc, n_words, whole, content, prints) of (doc, text)."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for doc, grams in documents(batch.column(1)):
                for column, x in zip(out, (doc.n, hashlib.sha256(doc.text).hexdigest(), doc.content, np.unique(window_prints(grams))), strict=True):
                    column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc", "n_words", "whole", "content", "prints"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "doc bigint, n_words bigint, whole string, content binary, prints array<bigint>")


class FingerprintIndex:
    """Sorted immutable runs of (print, doc) in the shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch, self.runs = spark, scratch, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"sparkledger_run_{uuid.uuid4().hex}"
        path = f"{self.scratch.root}/{name}"
        rows.repartition(self.buckets, "print").sortWithinPartitions("print").write.bucketBy(self.buckets, "print").sortBy("print").option("path", path).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.scratch.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Add distinct (print, doc) rows of a batch; (print, doc) of the batch and of history whose print is in two documents, one of them in the batch."""
        run = self._write(rows)
        new = self.spark.table(run)
        keys = new.groupBy("print").agg(F.count("*").alias("n"))
        hits = []
        old_keys = None
        for name in self.runs:
            found = self.scratch.save(self.spark.table(name).hint("merge").join(keys.select("print"), "print", "left_semi"), "history")
            hits.append(found)
            part = found.select("print")
            old_keys = part if old_keys is None else old_keys.union(part)
        shared = keys.filter("n > 1").select("print")
        if old_keys is not None:
            shared = shared.union(old_keys).distinct()
        hits.append(self.scratch.save(new.hint("merge").join(shared, "print", "left_semi"), "batch"))
        self.runs.append(run)
        if len(self.runs) > FAN_IN:
            self.compact()
        out = hits[0]
        for x in hits[1:]:
            out = out.union(x)
        return out

    def compact(self) -> None:
        """Merge all runs into one."""
        rows = None
        for name in self.runs:
            t = self.spark.table(name)
            rows = t if rows is None else rows.union(t)
        merged = self._write(rows.distinct())
        for name in self.runs:
            self._drop(name)
        self.runs = [merged]

    def close(self) -> None:
        while self.runs:
            self._drop(self.runs.pop())


def _windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, doc, content, start) of the windows behind the prints of (doc, text, content, prints)."""

    def run(batches):
        for batch in batches:
            names = batch.schema.get_field_index
            for (doc, grams), d, content, prints in zip(
                documents(batch.column(names("text"))), batch.column(names("doc")).to_pylist(), batch.column(names("content")).to_pylist(), batch.column(names("prints")), strict=True
            ):
                if doc.content != content:
                    continue
                starts = np.flatnonzero(np.isin(window_prints(grams), np.asarray(prints.values)))
                if not len(starts):
                    continue
                begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in doc.words])))
                text = doc.text
                digest = b"".join(hashlib.blake2b(text[a : b - 1], digest_size=16).digest() for a, b in zip(begin[starts].tolist(), begin[starts + WINDOW].tolist(), strict=True))
                halves = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].astype(np.int32)), pa.array(np.full(n, d, dtype=np.int64)), pa.array([content] * n, pa.binary()), pa.array(starts.astype(np.int32))],
                    names=["h1", "h2", "doc", "content", "start"],
                )

    return texts.mapInArrow(run, "h1 bigint, h2 int, doc bigint, content binary, start int")


def _cut(texts: DataFrame) -> DataFrame:
    """(doc, content, n_removed, kept_text) of (doc, text, content, starts): the words no window of ``starts`` covers."""

    def run(batches):
        for batch in batches:
            names = batch.schema.get_field_index
            out = ([], [], [], [])
            for (doc, _), d, content, starts in zip(
                documents(batch.column(names("text"))), batch.column(names("doc")).to_pylist(), batch.column(names("content")).to_pylist(), batch.column(names("starts")), strict=True
            ):
                if doc.content == content:
                    s = np.asarray(starts.values)
                    steps = np.bincount(s, minlength=doc.n + 1) - np.bincount(s + WINDOW, minlength=doc.n + 1)[: doc.n + 1]
                    keep = np.cumsum(steps)[: doc.n] == 0
                    for column, x in zip(out, (d, content, int(doc.n - keep.sum()), b" ".join(w for w, k in zip(doc.words, keep.tolist(), strict=True) if k)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["doc", "content", "n_removed", "kept_text"])

    return texts.mapInArrow(run, "doc bigint, content binary, n_removed bigint, kept_text binary")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc, n_words, whole, content, rep) of all rows, and cuts (doc, content, n_removed, kept_text) of representatives that lose words.

    ``rep`` is the smallest doc_id with the same words, null where there is no window.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    profiles = scratch.save(_profiles(texts), "profiles")
    reps = profiles.filter(f"n_words >= {WINDOW} AND doc IS NOT NULL").groupBy("content").agg(F.min("doc").alias("rep"))
    rows = scratch.save(profiles.drop("prints").join(reps, "content", "left"), "rows")
    prints = scratch.save(profiles.join(rows.filter("doc = rep").select("doc", "content").distinct(), ["doc", "content"], "left_semi").select("doc", "content", "prints"), "prints")
    scratch.drop(profiles)

    index = FingerprintIndex(spark, scratch)
    bounds = prints.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [0.5], 10000)).first()[0] or []
    low, hits = None, None
    for high in [*(bounds if batches > 1 else []), None]:
        part = prints
        if low is not None:
            part = part.filter(F.col("doc") > low)
        if high is not None:
            part = part.filter(F.col("doc") <= high)
        found = index.ingest(part.select(F.explode("prints").alias("print"), "doc").distinct())
        hits = found if hits is None else hits.union(found)
        low = high
    # A document's shared prints are no more than its own windows.
    shared = scratch.save(hits.groupBy("doc").agg(F.collect_set("print").alias("prints")), "shared")
    index.close()
    chosen = prints.select("doc", "content").join(shared, "doc")
    some = only(texts, shared, "doc", shared.count())
    windows = scratch.save(_windows(some.join(chosen, "doc").select("doc", "text", "content", "prints")), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("h1", "h2", "low")
    gone = windows.join(first, ["h1", "h2"]).filter("doc > low").groupBy("doc", "content").agg(F.collect_list("start").alias("starts"))
    gone = scratch.save(gone, "gone")
    scratch.drop(windows)
    some = only(texts, gone.select("doc").distinct(), "doc", gone.count())
    cuts = scratch.save(_cut(some.join(gone, "doc").select("doc", "text", "content", "starts")).dropDuplicates(["doc", "content"]), "cuts")
    return rows, cuts


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = dedup(table(spark, sf_dir, "documents"))
    cuts = cuts.select("doc", "content", "n_removed", F.sha2("kept_text", 256).alias("cut"))
    copy = F.col("doc") > F.col("rep")
    return rows.join(cuts, ["doc", "content"], "left").select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut", "whole")).alias("kept_sha256"),
    )


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL: dict[str, str] = {}
