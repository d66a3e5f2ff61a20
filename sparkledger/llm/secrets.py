"""Secret scans by one combined deterministic automaton.

All rules are compiled together by subset construction and minimisation into
one transition array; a single pass over the bytes of a text reports where
rules fire.  A rule's span is then settled by two small automata of the rule
itself, compiled the same way: backwards to the leftmost start, forwards to the
longest end.  Matches of one kind do not overlap, and one that fails the
kind's condition still uses up its text.

``scan`` gives one row per document: ``spans`` is an array of (kind, start,
end) in code points, end exclusive, ordered by start and then by the order of
``RULES``.  Null text counts as empty, empty text has an empty array, repeated
rows are scanned each, an empty table gives an empty table, and other columns
pass through (one named ``spans`` is replaced).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .automaton import Dfa, parse
from .common import small_batches, table


class Rule(NamedTuple):
    """fires: what the pass looks for (a match of it begins every match of pattern that passes, or it is the pattern);
    least: bytes that the match, or what follows the ``value``, must have."""

    kind: str
    pattern: str
    fires: str
    least: int
    value: str = ""
    fold: bool = False
    base: bool = False


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# The first three kinds and their order are the contract's; the rest are published token shapes.
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", _KEY + "[A-Za-z0-9+/_.=-]", 6, value=_KEY, fold=True, base=True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 20, base=True),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", 24, base=True),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", 20),
    Rule("web", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", 36),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.all = Dfa([parse(r.fires, r.fold) for r in rules], search=True)
        self.back = [Dfa([parse(r.fires, r.fold)], search=False, backward=True) for r in rules]
        self.ahead = [Dfa([parse(r.pattern, r.fold)], search=False) for r in rules]
        self.value = [Dfa([parse(r.value, r.fold)], search=False) if r.value else None for r in rules]

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, at: int, stop: int, step: int) -> int | None:
        """Where the longest match from ``at`` towards ``stop`` ends, if there is one."""
        state, table, accepting, dead, found = dfa.start, dfa.table, dfa.first_accepting << 8, dfa.dead, None
        while at != stop:
            state = table[state | data[at]]
            at += step
            if state >= accepting:
                found = at
            elif state == dead:
                break
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        used, out = [0] * len(self.rules), []
        table, state, accepting, accepts = self.all.table, self.all.start, self.all.first_accepting << 8, self.all.accepts
        for i, byte in enumerate(data):
            state = table[state | byte]
            if state >= accepting:
                for k in accepts[state >> 8]:
                    if i >= used[k]:
                        before = self._longest(self.back[k], data, i, used[k] - 1, -1)
                        if before is None:  # it began in text that is used up
                            continue
                        start = before + 1
                        end = self._longest(self.ahead[k], data, start, len(data), 1)
                        used[k] = end
                        begin = self._longest(self.value[k], data, start, end, 1) if self.value[k] else start
                        if end - begin >= self.rules[k].least:
                            out.append((start, k, end))
        return sorted(out)

    def text_spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        data = text.encode("utf-8")
        found = self.spans(data)
        if not found or len(data) == len(text):
            return [(self.rules[k].kind, a, b) for a, k, b in found]
        return [(self.rules[k].kind, len(data[:a].decode("utf-8")), len(data[:b].decode("utf-8"))) for a, k, b in found]


@lru_cache(maxsize=2)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    keep = [c for c in df.columns if c.lower() != "spans"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches):
        one = scanner(rules)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in one.text_spans(x.as_py() or "")] for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(found, type=pa.list_(_SPAN))], names=[*keep, "spans"])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *(f"CAST(size(filter(spans, x -> x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base),
        f"sha2({text.format(f'filter(spans, x -> x.kind IN ({base}))')}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
