"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``features`` adds the counts, ``judge`` adds ``base_failed``, ``failed_rules``
and ``kept``.  Null or blank text has no words and fails the base rule.  Every
ratio is compared as integers, so equality at a threshold is exact: a rule
fails only strictly beyond it.  Repeated rows are judged row by row; an empty
table gives an empty table; columns other than the text pass through
untouched, and counts of the same names as existing columns replace them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

SPACE = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by this be at or from an are but not "
    "der die das und zu den ist von mit ein eine auf für sich nicht auch dem des im als "
    "le la les de et un une du en est que qui dans pour sur au avec par ne pas plus "
    "el y los se del las por con no su al es lo como para"
).split()


class Rule(NamedTuple):
    """Fails where 100 * count * sign > percent * of * sign, on texts of at least min_words words."""

    name: str
    count: str
    of: str
    percent: int
    at_most: bool = True
    min_words: int = 0


RULES = (
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("mean_word_long", "word_chars", "n_words", 1200, min_words=20),
    Rule("mean_word_short", "word_chars", "n_words", 250, at_most=False, min_words=20),
    Rule("stop_words", "n_stop_words", "n_words", 6, at_most=False, min_words=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", 50),
)
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

# Words are taken one by one: slice() copies the whole array of words that a row holds.
_FIVE = ", ".join(f"_words[i + {k}]" for k in range(5))


def _same(at: str) -> str:
    a, b = f"CAST(c[{at}] & _m AS INT)", "CAST(x & _m AS INT)"
    return f"(shiftright(c[{at}], _b) = shiftright(x, _b) AND " + " AND ".join(f"_words[{a} + {k}] = _words[{b} + {k}]" for k in range(5)) + ")"


# Windows found twice or more: sort (hash | index) packed in longs, keep neighbours of one hash, confirm them on their
# words (also one further off, should another window share the hash), and add up what the windows cover.
_REPEATS = f"""
CASE WHEN size(array_distinct(_h)) = size(_h) THEN 0L ELSE
  transform(array(sort_array(transform(_h, (x, i) -> shiftleft(shiftright(x, _b), _b) | CAST(i AS BIGINT)))), s ->
   transform(array(filter(s, (x, i) -> (i > 0 AND shiftright(s[greatest(i - 1, 0)], _b) = shiftright(x, _b))
                                    OR (i < size(s) - 1 AND shiftright(s[least(i + 1, size(s) - 1)], _b) = shiftright(x, _b)))), c ->
    transform(array(sort_array(transform(filter(c, (x, i) ->
        (i > 0 AND {_same("greatest(i - 1, 0)")}) OR (i < size(c) - 1 AND {_same("least(i + 1, size(c) - 1)")})
        OR (i > 1 AND {_same("greatest(i - 2, 0)")}) OR (i < size(c) - 2 AND {_same("least(i + 2, size(c) - 1)")})), x -> CAST(x & _m AS INT)))), p ->
     aggregate(transform(p, (x, i) -> CASE WHEN i = size(p) - 1 THEN 5 ELSE least(5, p[least(i + 1, size(p) - 1)] - x) END), 0L, (a, x) -> a + x)
    )[0])[0])[0] END"""


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    counts = {
        "n_words": "CAST(size(_words) AS BIGINT)",
        "word_chars": "CAST(length(array_join(_words, '')) AS BIGINT)",
        "n_symbols": f"CAST(size(split(_t, '{SYMBOLS}')) - 1 AS BIGINT)",
        "n_lines": "CAST(size(_lines) AS BIGINT)",
        "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
        "n_stop_words": f"CAST(size(filter(_words, w -> lower(w) IN ({stop}))) AS BIGINT)",
        "_h": f"CASE WHEN size(_words) < 5 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_words) - 5), i -> xxhash64({_FIVE})) END",
        "_b": "length(bin(size(_words)))",
        "_m": "shiftleft(1L, length(bin(size(_words)))) - 1",
    }
    helpers = ("_t", "_words", "_lines", "_h", "_b", "_m")
    own = dict(zip(helpers, unused(docs, *helpers), strict=True))
    e = lambda sql: F.expr(re.sub(r"(?<![\w'])_(?:t|words|lines|h|b|m)\b", lambda m: own[m.group()], sql))
    df = docs.withColumn(own["_t"], F.expr(f"coalesce(`{text}`, '')")).withColumns(
        {own["_words"]: e(f"array_remove(split(_t, '{SPACE}'), '')"), own["_lines"]: e(r"filter(split(_t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')")}
    )
    df = df.withColumns({own.get(k, k): e(v) for k, v in counts.items()}).drop(own["_t"], own["_lines"])
    return df.withColumn("n_repeat_words", e(_REPEATS)).drop(own["_words"], own["_h"], own["_b"], own["_m"])


def rule_sql(r: Rule) -> str:
    """The predicate of a failed rule; the same text in Spark and in DuckDB."""
    return f"(n_words >= {r.min_words} AND 100 * {r.count} {'>' if r.at_most else '<'} {r.percent} * {r.of})"


def judge(df: DataFrame, rules=RULES) -> DataFrame:
    """df of ``features`` with base_failed, failed_rules (array of names) and kept."""
    failed = "filter(array(" + ", ".join(f"CASE WHEN {rule_sql(r)} THEN '{r.name}' END" for r in rules) + "), x -> x IS NOT NULL)"
    return df.withColumns({"base_failed": F.expr(BASE), "failed_rules": F.expr(failed)}).withColumn("kept", F.expr("NOT base_failed AND size(failed_rules) = 0"))


def kept_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a condition on computed columns. The row number keeps Catalyst from moving the condition below the
    projections, where every use of an array would compute it anew, inside lambdas once for each element."""
    (row,) = unused(df, "_row")
    return df.withColumn(row, F.monotonically_increasing_id()).filter(f"({condition}) AND {row} >= 0").drop(row)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(features(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def features_sql(source: str = "documents") -> str:
    """DuckDB: the counts of ``features`` for doc_id, text of a relation."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
    t AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    u AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, ws FROM w),
    g AS (SELECT doc_id, i, ws[i] AS a, CASE WHEN i <= len(ws) - 4 THEN ws[i:i + 4] END AS win FROM u),
    d AS (SELECT doc_id, i, a,
                 CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN i END AS p FROM g),
    c AS (SELECT doc_id, i, a, max(p) OVER (PARTITION BY doc_id ORDER BY i) AS lastp FROM d),
    k AS (SELECT doc_id, sum(CASE WHEN lastp IS NOT NULL AND i - lastp < 5 THEN 1 ELSE 0 END) AS n_repeat_words,
                 sum(CASE WHEN lower(a) IN ({stop}) THEN 1 ELSE 0 END) AS n_stop_words FROM c GROUP BY doc_id),
    f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                 len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop_words, 0)::BIGINT AS n_stop_words FROM w LEFT JOIN k USING (doc_id))"""


ANY_RULE = " OR ".join(map(rule_sql, RULES))
ORACLE = f"""WITH {features_sql()}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed,
           NOT ({BASE} OR {ANY_RULE}) AS kept, n_lines, n_stop_words FROM f"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": ORACLE}
