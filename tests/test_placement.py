"""Placement is a weighted choice without replacement on distinct hosts, and costs no pair of request and node."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkledger.operators import placement


def ring(nodes):
    i, h, w = zip(*sorted(nodes, key=lambda x: x[1]), strict=True)
    return placement.Ring(pa.table({"node_id": pa.array(i, pa.int64()), "host": pa.array(h), "weight": pa.array(w, pa.int64())}))


def chances(nodes, count):
    """Probability of each ordered choice by the sequential loop."""
    out = {}
    for pick in itertools.permutations(nodes, count):
        if len({h for _, h, _ in pick}) == count:
            p, used = 1.0, set()
            for _, h, w in pick:
                p *= w / sum(x for _, g, x in nodes if g not in used)
                used.add(h)
            out[tuple(i for i, _, _ in pick)] = p
    return out


NODES = [(1, "a", 5), (2, "a", 1), (3, "b", 7), (4, "c", 2), (5, "c", 2), (6, "d", 1)]


@pytest.mark.parametrize("scale", [1, 1 << 59])
def test_choices_have_the_chances_of_the_sequential_loop(scale):
    n = 100_000 if scale == 1 else 20_000
    r, want = ring([(i, h, w * scale) for i, h, w in NODES]), chances(NODES, 3)
    draws = [np.random.default_rng(k).integers(0, 1 << 63, n) for k in range(3)]
    got = Counter(tuple(x) for x in np.asarray(r.node_ids)[r.choose(draws).astype(np.int64)].tolist())
    assert r.exact == (scale == 1) and set(got) <= set(want) and abs(sum(want.values()) - 1) < 1e-9
    chi = sum((got[k] - n * p) ** 2 / (n * p) for k, p in want.items())
    assert chi < len(want) + 6 * (2 * len(want)) ** 0.5


def test_place(spark):
    nodes = spark.createDataFrame([(i, f"h{i % 5}", 10 + i) for i in range(40)], "node_id long, host string, free_bytes long")
    requests = spark.createDataFrame([(i % 90,) for i in range(100)], "request long")
    rows = placement.place(requests, nodes, 3, 17).collect()
    assert rows == placement.place(requests, nodes, 3, 17).collect()
    by = {k: sorted((r.rank, r.host) for r in rows if r.request == k) for k in range(90)}
    assert len(rows) == 270 and all([x for x, _ in v] == [1, 2, 3] and len({h for _, h in v}) == 3 for v in by.values())
    assert all(r.host == f"h{r.node_id % 5}" for r in rows)
    assert placement.place(requests, nodes, 6, 17).count() == 0 and placement.place(requests, nodes.limit(0), 3, 17).count() == 0


def test_no_pairs(spark):
    """Requests by nodes would be two thousand million pairs."""
    requests, nodes = spark.range(200_000).withColumnRenamed("id", "request"), spark.range(10_000).selectExpr("id AS node_id", "'h' || id % 25 AS host", "1 + id AS free_bytes")
    out = placement.place(requests, nodes, 3, 17)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and out.count() == 600_000
