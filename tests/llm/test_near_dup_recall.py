"""Pairs near the threshold in nodes that stay crowded."""

import numpy as np

from sparkledger.llm import near_dup


def test_pairs_at_the_threshold_survive_crowded_levels():
    """Of 250 pairs at 0.75 to 0.8 hardly any leaves all trees within eight levels."""
    rng = np.random.default_rng(11)
    lost = 0
    for i in range(250):
        union, both = 400, 300 + i % 20
        values = rng.integers(0, 2**63, union, dtype=np.uint64) * np.uint64(2)
        half = both + (union - both) // 2
        a, b = np.sort(values[:half]), np.sort(np.concatenate((values[:both], values[half:])))
        with np.errstate(over="ignore"):
            met = np.intersect1d(near_dup.root_nodes(near_dup.signature(a)), near_dup.root_nodes(near_dup.signature(b)))
            for level in range(8):
                met = np.intersect1d(near_dup.child_nodes(met, a, level), near_dup.child_nodes(met, b, level)) if len(met) else met
        lost += not len(met)
    assert lost <= 2
