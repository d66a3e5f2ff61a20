"""Small frames with nulls, repeats, long texts and clashing columns."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two three"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "é漢字🙂 naïve  text\n\nsecond line"),
    (9, "é漢字🙂 naïve  text\n\nsecond line"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"),
]


def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
