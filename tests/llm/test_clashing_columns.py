"""Extra columns whose names the operators use themselves pass through."""

from helpers import EDGE, edge, empty

from sparkledger.llm import decontaminate, licenses, line_dedup, quality, substring_dedup


def test_quality(spark):
    names = ["_t", "_words", "_lines", "_h", "_b", "_m", "_row"]
    plain = quality.kept_rows(quality.judge(quality.features(edge(spark))), "n_words >= 0").collect()
    df = edge(spark).selectExpr("*", *[f"'{n}' AS {n.upper() if n == '_h' else n}" for n in names])
    got = quality.kept_rows(quality.judge(quality.features(df)), "n_words >= 0").collect()
    assert len(got) == len(EDGE) and all(r["_t"] == "_t" and r["_H"] == "_h" and r["_row"] == "_row" for r in got)
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.kept) for r in got) == sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.kept) for r in plain)


def test_line_dedup(spark):
    df = edge(spark).selectExpr("*", *[f"7 AS {n}" for n in ("_doc", "_gone", "_u", "_n", "_kept", "doc", "k")])
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(EDGE) and all(r["_doc"] == r["_kept"] == r["doc"] == 7 for r in got)


def test_others(spark):
    df = edge(spark).selectExpr("*", *[f"7 AS {n}" for n in ("doc", "content", "start", "item_id", "edits", "end", "license")])
    items = spark.createDataFrame([(1, EDGE[0][1]), (2, None)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    assert {r.doc_id for r in decontaminate.matches(df, items).collect()} == {1, 2, None}
    assert licenses.scan(df).count() == 0 and decontaminate.matches(empty(spark), items).count() == 0
    rows, _ = substring_dedup.dedup(df)
    assert rows.count() == len(EDGE)
