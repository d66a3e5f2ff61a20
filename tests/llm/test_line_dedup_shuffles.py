"""Line dedup moves no texts to meet a short list, and takes every kind of white space between words."""

from sparkledger.llm import line_dedup


def test_texts_are_not_shuffled_to_meet_few_lines(spark):
    docs = spark.createDataFrame([(i, f"a line of its own {i}\nthe line that all have") for i in range(50)], "doc_id bigint, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.dedup(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {r.doc_id: (r.text, r.n_removed_lines) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows[0] == ("a line of its own 0\nthe line that all have", 0)
    assert all(rows[i] == (f"a line of its own {i}", 1) for i in range(1, 50))


def test_white_space_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(20)]
    odd = "".join(w + "\t\x0b\x0c\r "[i % 5] for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, odd), (3, "f".join(words)), (5, "one that is left alone"), (5, "f".join(words)), (6, "one that is  left alone")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_removed_lines) for r in got.collect()) == [(1, 0), (2, 1), (3, 0), (5, 1), (5, 1), (6, 1)]
