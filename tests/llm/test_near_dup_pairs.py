"""Candidates of nodes that are compared exhaustively."""

from sparkledger.llm import near_dup


def test_a_pair_that_meets_in_several_nodes_is_taken_once(spark):
    mini = [0] * near_dup.LONGS
    rows = [(node, doc, label, main, 100, mini) for node, main, members in ((10, 1, ((1, 1), (2, 2))), (20, 2, ((1, 1), (2, 2), (3, 2))), (30, 1, ((4, 1), (1, 1), (2, 2)))) for doc, label in members]
    few = spark.createDataFrame(rows, "node bigint, doc bigint, label bigint, main bigint, n bigint, mini array<bigint>")
    assert sorted(map(tuple, near_dup._exhaustive(few).collect())) == [(1, 2), (1, 3), (2, 4)]
