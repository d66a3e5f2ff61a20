"""Operators that compare documents, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from helpers import EDGE, LONG, edge, empty

from sparkledger.llm import line_dedup, near_dup, substring_dedup
from sparkledger.llm.common import Scratch
from sparkledger.llm.components import components

SCHEMA = "doc_id long, text string"


def corpus(seed, n=120):
    """Random documents with copies, near copies in chains and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "of", "the"]) if rng.random() < 0.2 else f"w{rng.randrange(3000)}"
    text = lambda n: " ".join(("\n" if rng.random() < 0.05 else "") + word() for _ in range(n))
    passage, docs = text(30), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and docs:
            words = rng.choice(docs).split(" ")
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = word()
            docs.append(" ".join(words))
        elif kind < 0.4:
            docs.append(text(rng.randint(5, 40)) + " " + passage + " " + text(rng.randint(5, 40)))
        else:
            docs.append(text(rng.choice([0, 1, 3, 6, 15, 60, 200])))
    return list(enumerate(docs))


def ascii_lower(text):
    return (text or "").encode().lower().split()


def shingles(words):
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [(d, shingles(ascii_lower(t))) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return Counter((d, len(s), find(d), find(d) == d) for d, s in sets)


@pytest.mark.parametrize("seed, small", [(1, 32), (2, 2)])
def test_near_dup(spark, seed, small):
    rows = corpus(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=small).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_near_dup_edges(spark):
    got = near_dup.near_duplicates(edge(spark).selectExpr("*", "1 AS n", "2 AS node")).collect()
    assert len(got) == len(EDGE)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[2, 14] == 1 and by[3, 0] == 3 and by[4, 0] == 4 and by[6, 1] == 6 and by[9, 1] == 9
    assert [c for (d, n), c in by.items() if d == 8] == [7]
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if x != p}


def brute_cut(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - 12):
                first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return Counter(out)


def cut(df, batches):
    from pyspark.sql import functions as F

    rows, cuts = substring_dedup.dedup(df, batches=batches)
    cuts = cuts.select("doc", "content", "n_removed", F.sha2("kept_text", 256).alias("cut"))
    copy = F.col("doc") > F.col("rep")
    out = rows.join(cuts, ["doc", "content"], "left").select("doc", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut", "whole")))
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("batches", [1, 6])
def test_substring_dedup(spark, batches):
    rows = corpus(5)
    assert cut(spark.createDataFrame(rows, SCHEMA), batches) == brute_cut(rows)


def test_substring_dedup_edges(spark):
    assert cut(edge(spark), 2) == brute_cut(EDGE)
    assert not cut(empty(spark), 2)


def brute_lines(rows):
    """Texts after line deduplication, for distinct documents."""
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.encode().split()]
    sets = {x: shingles(x.encode().split()) for _, _, x in lines}
    inverted, first = defaultdict(set), {}
    for d, i, x in sorted(lines, key=lambda r: r[:2]):
        first.setdefault(x, (d, i))
    for x, s in sets.items():
        for token in s:
            inverted[token].add(x)
    gone = set()
    for x, s in sets.items():
        for y in {y for token in s for y in inverted[token]} - {x}:
            both = len(s & sets[y])
            if first[y] < first[x] and 4 * both >= 3 * (len(s) + len(sets[y]) - both):
                gone.add(x)
    kept, n, r = defaultdict(list), Counter(), Counter()
    for d, i, x in lines:
        n[d] += 1
        if first[x] == (d, i) and x not in gone:
            kept[d].append(x)
        else:
            r[d] += 1
    return {d: (n[d], r[d], "\n".join(kept[d]) if r[d] else t) for d, t in rows}


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join(f"v{rng.randrange(4000)}" for _ in range(rng.choice([1, 4, 8, 40, 80]))) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))

    def line():
        words = rng.choice(base).split(" ")
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        return " ".join(words) + (" " + passage if rng.random() < 0.3 else "") if rng.random() < 0.95 else ""

    rows = [(d, "\n".join(line() for _ in range(rng.randint(0, 8)))) for d in range(80)]
    for frequent in (64, 3):  # the second moves many tokens to the end of the order
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    got = line_dedup.dedup(edge(spark).selectExpr("*", "1 AS gone", "2 AS token", "3 AS n_lines")).collect()
    assert len(got) == len(EDGE) and line_dedup.dedup(empty(spark)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed_lines == 0 and by[2].n_removed_lines == 1 and by[2].text == "" and by[3].text is None and by[5].text == EDGE[4][1]
    assert by[7].text == LONG and by[8].n_removed_lines == 1 and by[None].text == EDGE[-1][1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    from sparkledger.llm import decontaminate

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, docs))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "line dedup":
            want = brute_lines(sorted(old.items()))
            assert new == {d: t for d, (n, r, t) in want.items() if n == 0 or r < n}
        elif name == "MinHash near-dedup":
            assert set(new) == {d for d, _, _, kept in brute_components(sorted(old.items())) if kept}
        elif name == "benchmark decontamination":
            items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(new) == {d for d, t in old.items() if not decontaminate.Matcher(items).matches(decontaminate.normal(t))}
        elif name == "byte-level BPE":
            assert docs.filter("NOT round_trip").count() == 0 and set(new) == set(old) and docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0
        else:
            assert set(new) <= set(old) and all(new[d] == old[d] for d in new)


def test_queries_match_sql(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from oracle import same, views

    from sparkledger.llm.catalog import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = views(folder)
    for name, sql in SQL.items():
        same(QUERIES[name](spark, folder).toPandas(), con, sql)
