"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters (lower-cased, every run of other characters than
letters and digits one space) may occur with up to ``m // 10`` edits.  It is
cut into that budget plus one pieces, so at least one piece stands unharmed in
every such occurrence.  One automaton finds the exact hits of all pieces in a
document, and the text around a hit is verified with Myers' bit-parallel edit
distance, the pattern in one integer: first of small runs of pieces around the
hit, each with its share of the budget, then of larger ones up to the item.

Documents are taken whole.  Null and empty texts match nothing, as do items
without a letter or digit; equal items each match; of several occurrences the
least distance counts, and of those the earliest; repeated rows are scanned
each; empty tables give an empty table.  The items go to the workers in blocks
of bounded size, one scan per block.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, small_batches, table

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 10
#: Characters of items in a block; bounds what is broadcast and the automaton's memory.
BLOCK_CHARS = 1 << 20

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [round(i * len(item) / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and a substring of the text, and where the earliest such substring ends."""
    m = len(pattern)
    high, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up <<= 1
        plus = ((down << 1) | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, at = score, i + 1
    return best, at


class Node:
    """A run of an item's pieces with its own budget, one edit less than it has pieces."""

    __slots__ = ("text", "start", "end", "budget", "masks")

    def __init__(self, item: str, start: int, end: int, budget: int):
        self.text, self.start, self.end, self.budget = item[start:end], start, end, budget
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(self.text):
            self.masks[c] |= 1 << i


def paths(item: str) -> list[tuple[str, int, list[Node]]]:
    """(piece, offset, nodes from the piece's parent up to the whole item) of each piece.

    An occurrence within the budget of a node is within the budget of one of its halves, so from the item down to some
    piece every node matches; a hit is followed up that way and given up at the first node that does not.
    """
    parts = pieces(item, len(item) // CHARS_PER_EDIT)
    out: list = [(piece, offset, []) for offset, piece in parts]

    def halve(a: int, b: int) -> None:
        if b - a > 1:
            halve(a, (a + b) // 2)
            halve((a + b) // 2, b)
            node = Node(item, parts[a][0], parts[b - 1][0] + len(parts[b - 1][1]), b - a - 1)
            for i in range(a, b):
                out[i][2].append(node)

    halve(0, len(parts))
    return out


class Matcher:
    """Automaton of all pieces of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items, places = items, defaultdict(list)
        for k, (_, text) in enumerate(items):
            for piece, offset, nodes in paths(text):
                places[piece].append((k, offset, nodes))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, end in the normalised text) of each item within its budget."""
        if self.empty:
            return []
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, tuple[int, int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, offset, nodes in found:
                zero = end + 1 - size - offset  # where the item begins if nothing before the piece was edited
                if k in seen and nodes and seen[k] == (zero, nodes[-1].budget):
                    continue
                edits, at = 0, size
                low = end + 1 - size
                for node in nodes:
                    low = max(0, zero + node.start - node.budget)
                    edits, at = myers(node.text, node.masks, text[low : zero + node.end + node.budget])
                    if edits > node.budget:
                        break
                else:
                    if nodes:
                        seen[k] = (zero, nodes[-1].budget)
                    if k not in best or (edits, low + at) < best[k]:
                        best[k] = (edits, low + at)
        return [(self.items[k][0], *x) for k, x in best.items()]


#: A worker's automaton, by the broadcast it was built from.
_MATCHERS: dict[str, Matcher] = {}


def _blocks(items: DataFrame, item_id: str, text: str):
    """Lists of (item_id, normalised text) of bounded size."""
    block, size = [], 0
    for i, t in items.select(item_id, text).toLocalIterator():
        t = normal(t)
        if t:
            block.append((i, t))
            size += len(t)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, end) of every document that holds an item within its budget."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, edits int, end bigint"
    small_batches(spark)
    out = None
    for block in _blocks(items, item_id, item_text):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, key=key):
            if key not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[key] = Matcher(sent.value)
            matcher = _MATCHERS[key]
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.matches(normal(t.as_py()))]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "end"])

        found = docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.range(0).selectExpr("id AS doc_id", "id AS item_id", "CAST(id AS INT) AS edits", "id AS end") if out is None else out


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; rows without doc_id stay."""
    found = Scratch(docs.sparkSession, "leaks").save(matches(docs, items, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct(), "leaks")
    side = F.broadcast(found) if found.count() * 16 <= BROADCAST_BYTES else found
    return docs.join(side, doc_id, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
