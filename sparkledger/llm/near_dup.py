"""MinHash near-deduplication by a chosen-path set similarity join.

A document's set is its distinct shingles of five words (the whole sequence if
it has fewer; none without words).  Equal sets are collapsed to one
representative first, so groups of copies cost one row each.  Every
representative then walks independent trees: a node branches along minwise
tokens under hash functions of its own, 1 / similarity of them in expectation,
to the children that hold all documents of the node with the same token.  The
first level comes from the signature; below it a document's path depends on its
own set alone, so ``DEPTH`` levels are drawn at a time, and only in nodes that
are still crowded.

In every node all documents are compared with the node's least one (a star,
linear in the node).  The links are joined to components, and a node whose
documents are of one component is settled.  In an unsettled node with up to
``SMALL`` documents outside its largest component these are compared with all
others, which is linear in the node as well; other nodes are crowded and branch
again, for ``ROUNDS`` rounds at most.  Candidates are screened while they are
joined, on ``7 * LONGS`` short minwise tokens packed in longs, and confirmed on
the full sets.

Empty and null texts have no set and are linked with nothing; rows that repeat
a doc_id are one document with all of these texts; ties keep the smallest
doc_id; an empty table gives an empty table; a null doc_id is linked with
nothing.  Only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, only, small_batches, table
from .components import components, merged, small_side
from .words import mix, slices, split_words, text_buffers

SHINGLE = 5
SIMILARITY = 0.75
#: Independent trees. A pair at the threshold meets at the first level of one tree with chance 0.75 or more; 16 trees
#: miss it with chance 0.25 ** 16 where nodes are small. Every crowded level below is a step of a critical branching
#: process that is drawn anew in each node; the README has the chance of a miss after so many levels.
TREES = 16
#: Levels that crowded nodes go down in one round, and rounds.
DEPTH, ROUNDS = 4, 8
#: Documents outside the largest component of a node up to which the node is compared exhaustively.
SMALL = 32
#: Longs of seven minwise tokens of seven bits each that screen candidates, and how many of the tokens must be equal: a pair
#: at the threshold fails with chance 7e-6 (4.5 deviations), one at 0.45 passes with chance 1e-2.
LONGS, EQUAL = 16, 63


def shingle_sets(words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    windows, _ = words.windows(SHINGLE)
    out = []
    for a, b in zip(words.doc_words[:-1].tolist(), words.doc_words[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words.hashes[a:b]:
                h = mix(np.array([h * np.uint64(31) + w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sets_of(column: pa.Array):
    raw, off = text_buffers(column)
    for a, b in slices(off):
        with np.errstate(over="ignore"):
            yield from shingle_sets(split_words(raw, off[a : b + 1], lower=True))


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: the least values under the hash functions a * x + b."""
    best = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(values), 2048):
        best = np.minimum(best, (values[i : i + 2048, None] * a + b).min(axis=0))
    return mix(best)


_SALT = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Trees that have a second node at the first level.
_SECOND = np.flatnonzero(_SALT[:TREES] % np.uint64(3) == 0)
#: Minwise tokens of a document: the first ones name the nodes of the first level, the others screen candidates.
ROOTS = TREES + len(_SECOND)
TOKENS = ROOTS + 7 * LONGS


def signature(values: np.ndarray) -> np.ndarray:
    """A set's tokens under TOKENS hash functions."""
    a, b = np.random.default_rng([715, 0]).integers(0, 2**63, (2, TOKENS), dtype=np.uint64)
    return least(values, a << np.uint64(1) | np.uint64(1), b)


def root_nodes(sig: np.ndarray) -> np.ndarray:
    """First-level nodes: one token for each tree, and a second one for a third of them."""
    return np.unique(mix(sig[:ROOTS] + _SALT[:ROOTS]).view(np.int64))


def packed(sig: np.ndarray) -> list[int]:
    """The short tokens of the screen, seven to a long with a free bit above each."""
    bits = (sig[ROOTS:] >> np.uint64(57)).reshape(LONGS, 7)
    return (bits << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(axis=1).astype(np.int64).tolist()


def node_hash(nodes: np.ndarray, level: int) -> np.ndarray:
    return mix(nodes.view(np.uint64) + _SALT[level % len(_SALT)])


def has_second(nodes: np.ndarray, level: int) -> np.ndarray:
    """Whether nodes have a second child for each document: a third of them."""
    return (node_hash(nodes, level) >> np.uint64(8)) % np.uint64(3) == 0


def child_nodes(nodes: np.ndarray, values: np.ndarray, level: int) -> np.ndarray:
    """Children of a document in nodes: one token under each node's own hash function, then the second ones."""
    with np.errstate(over="ignore"):
        h = node_hash(nodes, level)
        h = np.concatenate((h, mix(h[has_second(nodes, level)] + np.uint64(1))))
        a, b = mix(h + np.uint64(2)), mix(h + np.uint64(3))
        return mix(least(values, a | np.uint64(1), b) + mix(h + np.uint64(4))).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, n, digest, mini, nodes) of (doc, text)."""

    def run(batches):
        for batch in batches:
            n, digest, mini, nodes = [], [], [], []
            with np.errstate(over="ignore"):
                for s in sets_of(batch.column(1)):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    x = signature(s)
                    mini.append(packed(x))
                    nodes.append(root_nodes(x) if len(s) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(mini, longs), pa.array(nodes, longs)], names=["doc", "n", "digest", "mini", "nodes"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc bigint, n bigint, digest binary, mini array<bigint>, nodes array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc, members) of (doc, text): sorted shingle hashes packed in bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets_of(batch.column(1))], pa.binary())], names=["doc", "members"])

    return docs.mapInArrow(run, "doc bigint, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) that are similar enough on their full sets."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    u.append(a.as_py())
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    side = lambda c: sets.select(F.col("doc").alias(c), F.col("members").alias(f"m_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(run, "u bigint, v bigint")


def _descended(crowd: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """(node, parent, doc, first, last) of the next DEPTH levels below crowded nodes (node, doc)."""

    def run(batches):
        for batch in batches:
            out, above, docs, steps = [], [], [], []
            with np.errstate(over="ignore"):
                for p, d, s in zip(batch.column(0), batch.column(1).to_pylist(), sets_of(batch.column(2)), strict=True):
                    nodes = np.array(p.as_py(), dtype=np.int64)
                    for step in range(DEPTH if len(s) else 0):
                        children = child_nodes(nodes, s, level + step)
                        out.append(children)
                        above.append(np.concatenate((nodes, nodes[has_second(nodes, level + step)])))
                        docs += [d] * len(children)
                        steps += [step] * len(children)
                        nodes = np.unique(children)
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([flat(out), flat(above), pa.array(docs, pa.int64()), pa.array([x == 0 for x in steps], pa.bool_()), pa.array([x == DEPTH - 1 for x in steps], pa.bool_())], names=["node", "parent", "doc", "first", "last"])

    # A document is in few nodes: 4/3 of them for each node before, of which crowded ones are left.
    nodes = crowd.groupBy("doc").agg(F.collect_set("node").alias("nodes"))
    small_batches(texts.sparkSession)
    return _with(texts, nodes, crowd.count()).select("nodes", "doc", "text").mapInArrow(run, "node bigint, parent bigint, doc bigint, first boolean, last boolean")


def _with(texts: DataFrame, side: DataFrame, rows: int) -> DataFrame:
    """Texts joined with what few of them have: by a broadcast if so many rows of two longs are small, by a shuffle beyond that."""
    return texts.join(F.broadcast(side) if rows * 32 <= BROADCAST_BYTES else side.hint("merge"), "doc")


_EQUAL = " + ".join(f"bit_count(((x_mini[{i}] ^ mini[{i}]) + 35887507618889599) & 36170086419038336)" for i in range(LONGS))
#: x_n, x_mini and n, mini allow the similarity; the numbers have the lower bits, and the upper bit, of seven bytes set.
_SCREEN = f"100 * least(x_n, n) >= 75 * greatest(x_n, n) AND {7 * LONGS} - ({_EQUAL}) >= {EQUAL}"


def _grouped(members: DataFrame, minis: DataFrame) -> DataFrame:
    """Members (node, doc, ...) of nodes with several documents, with their ``hub``, the least one, and n, mini."""
    sizes = members.groupBy("node").agg(F.count("*").alias("c"), F.min("doc").alias("hub")).filter("c > 1").select("node", "hub")
    return members.join(sizes, "node").join(minis, "doc")


def _stars(groups: DataFrame) -> DataFrame:
    """Candidates (a, b) of every document and its node's least one."""
    hub = groups.filter("doc = hub").select("node", F.col("doc").alias("a"), F.col("n").alias("x_n"), F.col("mini").alias("x_mini"))
    return groups.filter("doc <> hub").withColumnRenamed("doc", "b").join(hub.dropDuplicates(["node"]), "node").filter(_SCREEN).select("a", "b")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of nodes of several components with each document's ``label``, the node's largest one (``main``), how many are
    ``outside`` it, and the ``hub``, the least document."""
    side = small_side(labels).select(F.col("u").alias("doc"), F.col("v").alias("label"))
    at = members.drop("hub").join(side, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    by_label = at.groupBy("node", "label").agg(F.count("*").alias("c"), F.min("doc").alias("hub"))
    open_ = by_label.groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("outside"), F.min("hub").alias("hub")).filter("outside > 0")
    return at.join(open_, "node")


def _exhaustive(few: DataFrame) -> DataFrame:
    """Candidates (a, b) of the documents outside a node's largest component and all others, each pair once.

    Every node pairs all its documents of different components, so a pair that meets in several nodes is taken in the least of
    them alone.
    """
    few = few.join(few.groupBy("doc").agg(F.collect_set("node").alias("at")), "doc")
    x = few.filter("label <> main").select("node", F.col("doc").alias("x"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("mini").alias("x_mini"), F.col("at").alias("x_at"))
    once = "array_min(array_intersect(x_at, at)) = node"
    return x.join(few, "node").filter(f"x_label <> label AND (label = main OR x < doc) AND {_SCREEN} AND {once}").select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b"))


def _links(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Confirmed edges (u, v) of candidates, written."""
    pairs = scratch.save(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = scratch.save(full_sets(only(texts, wanted, "doc", 2 * pairs.count())), "sets")
    out = scratch.save(_confirmed(pairs, sets), "links")
    scratch.drop(pairs, sets)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    sketch = scratch.save(sketches(texts), "sketches")
    firsts = sketch.filter("n > 0 AND doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("rep"))
    classes = scratch.save(sketch.select("doc", "n", "digest").join(firsts, "digest", "left").select("doc", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "classes")
    reps = scratch.save(sketch.join(classes.filter("doc = rep").select("doc").distinct(), "doc", "left_semi").select("doc", "n", "mini", "nodes"), "representatives")
    scratch.drop(sketch)
    # A doc_id with several texts links them all.
    several = classes.filter("rep <> doc").groupBy("doc").agg(F.min("rep").alias("v"), F.max("rep").alias("m")).filter("v <> m")
    edges = classes.join(several.select("doc", "v"), "doc").filter("rep <> v").select(F.col("rep").alias("u"), "v")

    minis = reps.select("doc", "n", "mini")
    groups = scratch.save(_grouped(reps.select(F.explode("nodes").alias("node"), "doc"), minis), "groups")
    labels = components(edges.union(_links(_stars(groups), texts, scratch)), scratch)
    open_ = scratch.save(_unsettled(groups, labels), "open")
    scratch.drop(groups)
    links = _links(_exhaustive(open_.filter(F.col("outside") <= small)), texts, scratch)
    crowd = open_.filter(F.col("outside") > small)
    for turn in range(ROUNDS):
        before, labels = labels, merged(labels, links, scratch)
        if labels is before:
            crowd = scratch.save(crowd.select("node", "doc"), "crowd")
        else:
            # What the last links have settled is no crowd any more.
            crowd = scratch.save(_unsettled(crowd.drop("label", "main", "outside"), labels).select("node", "doc"), "crowd")
            scratch.drop(before)
        scratch.drop(open_, links)
        if crowd.isEmpty():
            break
        members = scratch.save(_descended(crowd, texts, turn * DEPTH).distinct(), "members")
        # The short tokens come last: what is counted to find open nodes is narrow.
        groups = scratch.save(_unsettled(members, labels).join(minis, "doc"), "groups")
        scratch.drop(members, crowd)
        # Below a node that is compared exhaustively nothing new is met: only children of crowded nodes count.
        crowded = scratch.save(groups.filter(F.col("outside") > small).select(F.col("node").alias("parent")).distinct(), "crowded")
        below = groups.filter("NOT first").join(small_side(crowded), "parent", "left_semi")
        open_ = scratch.save(groups.filter("first").unionByName(below), "open")
        scratch.drop(groups, crowded)
        crowd = open_.filter(F.col("outside") > small)
        pairs = _exhaustive(open_.filter(F.col("outside") <= small)).union(_across(_stars(crowd), labels, "a", "b"))
        links = _links(pairs, texts, scratch)
        crowd = crowd.filter("last")
    else:
        labels = merged(labels, links, scratch)
    scratch.close(classes, labels)
    out = classes.join(labels.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _across(pairs: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose ends are in different components."""
    labels = small_side(labels)
    side = lambda c: labels.select(F.col("u").alias(c), F.col("v").alias(f"l_{c}"))
    both = pairs.join(side(a), a, "left").join(side(b), b, "left")
    return both.filter(F.coalesce(f"l_{a}", a) != F.coalesce(f"l_{b}", b)).select(*pairs.columns)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dup": op4_near_dup}
SQL: dict[str, str] = {}
