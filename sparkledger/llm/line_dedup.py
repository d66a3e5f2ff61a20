"""Line deduplication as an exact set-similarity join, in DataFrame and SQL functions only.

A line is a part of a text between line feeds that holds a word; its tokens
are its distinct shingles of five words (the whole line if it has fewer), as
64-bit hashes.  Lines are ordered by doc_id and place.  A line goes if it
equals an earlier line or if the Jaccard similarity of its tokens with those
of an earlier line is 0.75 or more, whether or not that one goes too.

Equal lines are settled first, by digest.  For the rest each line posts the
prefix of its tokens in a global order, by rarity: tokens are taken as rare
until their postings are found to be frequent, and lines that hold frequent
tokens in their prefix are posted again with these moved to the end, by count.
Lines that share a posted token and pass the length and positional filters are
candidates.  They are verified in two rounds: against the first line of each
token's group, then all others with the later lines that are still there.

A document that loses a line also loses its blank lines; any other text stays
as it is, byte for byte.  Null and empty texts have no lines; rows that repeat
a doc_id are one document, and of their lines at the same place none is
earlier; a row without doc_id keeps its text but for lines it repeats itself;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, only, table, unused

SHINGLE = 5
#: Postings of a token beyond which it counts as frequent.
FREQUENT = 64

_LINES = r"array_distinct(filter(split(coalesce({0}, ''), '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]'))"
#: Words are hashed once, each on its own; a split at one plain character needs no pattern.
_HASHES = r"""transform(array_remove(split(CASE WHEN line RLIKE '[\\x09-\\x0D]' THEN translate(line, '\t\u000B\u000C\r', '    ') ELSE line END, ' '), ''), w -> xxhash64(w))"""
_TOKENS = f"""sort_array(array_distinct(CASE WHEN size(hs) < {SHINGLE} THEN array(xxhash64(hs))
    ELSE transform(slice(hs, 1, size(hs) - {SHINGLE - 1}), (h, i) -> xxhash64(h, {", ".join(f"hs[i + {k}]" for k in range(1, SHINGLE))})) END))"""
#: Tokens of a set of n that one of every similar set must share: n - ceil(0.75 n) + 1.
_PREFIX = "size(tokens) - (3 * size(tokens) + 3) DIV 4 + 1"
_FILTERS = "4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y) AND 7 * (1 + least(n_x - p_x - 1, n_y - p_y - 1)) >= 3 * (n_x + n_y)"


def _tokens(lines: DataFrame, *names: str) -> DataFrame:
    """The columns named and ``tokens`` of lines (..., line)."""
    return lines.select(*names, F.expr(_HASHES).alias("hs")).select(*names, F.expr(_TOKENS).alias("tokens"))


def _prefixes(tokens: DataFrame, *names: str) -> DataFrame:
    """The columns named, the number of tokens and those to post, in their order."""
    return tokens.select(*names, F.expr("size(tokens)").alias("n"), F.expr(f"slice(tokens, 1, {_PREFIX})").alias("prefix"))


def _postings(prefixes: DataFrame) -> DataFrame:
    """(token, doc, k, n, p) of lines (doc, k, n, prefix)."""
    return prefixes.select("doc", "k", "n", F.posexplode("prefix").alias("p", "token")).select("token", "doc", "k", "n", "p")


def _without(postings: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Postings of other lines: by a broadcast set if the n lines are small, by a shuffle beyond that."""
    return postings.join(F.broadcast(lines) if n * 24 <= BROADCAST_BYTES else lines.hint("merge"), ["doc", "k"], "left_anti")


def _side(lists: DataFrame, name: str) -> DataFrame:
    """A written table (doc, list of k) to join with: by a broadcast if it is small by count, by a shuffle beyond that."""
    docs, n = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(name)), F.lit(0))).first()
    return F.broadcast(lists) if docs * 40 + n * 8 <= BROADCAST_BYTES else lists.hint("merge")


def _by_rarity(postings: DataFrame, counts: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """(doc, k) of the lines whose prefix holds a frequent token, and their postings with frequent tokens last; none if there are none."""
    frequent = scratch.save(counts.filter(f"c > {FREQUENT}").select("token"), "frequent")
    n = frequent.count()
    if not n:
        return None, None
    crowded = scratch.save(only(postings, frequent, "token", n).select("doc", "k").distinct(), "crowded")
    some = scratch.save(_lines_of(texts, crowded), "tokens")
    # Whatever is frequent among these lines moves too, so that the next prefix does not run into it; lines outside whose
    # prefix holds such a token are posted again as well, for all prefixes must follow one order.
    among = some.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f")).filter(f"f > {FREQUENT}")
    ranks = scratch.save(among, "ranks")
    hidden = scratch.save(ranks.join(frequent, "token", "left_anti").select("token"), "hidden")
    more = scratch.save(only(postings, hidden, "token", hidden.count()).select("doc", "k").distinct().join(crowded, ["doc", "k"], "left_anti"), "more")
    rest = scratch.save(_lines_of(texts, more), "tokens")
    ranked = some.union(rest).select("doc", "k", F.explode("tokens").alias("token")).join(ranks, "token", "left").select("doc", "k", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "token").alias("t"))
    # A line's tokens come together again; they are no more than its own words.
    again = ranked.groupBy("doc", "k").agg(F.expr("transform(sort_array(collect_list(t)), t -> t.token)").alias("tokens"))
    again = scratch.save(_postings(_prefixes(again, "doc", "k")), "again")
    scratch.drop(some, rest)
    moved = scratch.save(crowded.union(more), "moved")
    scratch.drop(frequent, ranks, hidden, crowded, more)
    return moved, again


def _lines_of(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, k, tokens) of lines (doc, k), a written table: the k-th distinct lines of (doc, text)."""
    by_doc = lines.groupBy("doc").agg(F.collect_list("k").alias("ks"))
    if lines.count() * 24 <= BROADCAST_BYTES:
        by_doc = F.broadcast(by_doc)
    else:
        ids = lines.select("doc").distinct()
        texts = only(texts, ids, "doc", ids.count())
    at = texts.join(by_doc, "doc").withColumn("u", F.expr(_LINES.format("text"))).select("doc", "u", F.explode("ks").alias("k"))
    return _tokens(at.filter("k < size(u)").select("doc", "k", F.expr("u[k]").alias("line")), "doc", "k")


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc, k) of the later lines of pairs (x_doc, x_k, doc, k) that are similar enough."""
    x = tokens.select(F.col("doc").alias("x_doc"), F.col("k").alias("x_k"), F.col("tokens").alias("x_tokens"))
    both = pairs.join(x, ["x_doc", "x_k"]).join(tokens, ["doc", "k"])
    overlap = both.withColumn("o", F.size(F.array_intersect("x_tokens", "tokens")))
    return overlap.filter("4 * o >= 3 * (size(x_tokens) + size(tokens) - o)").select("doc", "k").distinct()


def _round(pairs: DataFrame, known: DataFrame | None, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Later lines of similar pairs, and the tokens read so far."""
    pairs = scratch.save(pairs, "pairs")
    need = pairs.select("doc", "k").union(pairs.select(F.col("x_doc").alias("doc"), F.col("x_k").alias("k"))).distinct()
    if known is not None:
        need = need.join(known.select("doc", "k"), ["doc", "k"], "left_anti")
    more = scratch.save(_lines_of(texts, scratch.save(need, "need")), "verify")
    known = more if known is None else known.union(more)
    return scratch.save(_verified(pairs, known), "similar"), known


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gone): the indexes, among the distinct lines of a document, of those that go."""
    scratch = Scratch(docs.sparkSession, "lines")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL")
    # Every table goes as soon as its last reader is written. The texts are read once for the lines' digests and prefixes and are
    # not moved for that; prefixes stay packed by line. The full postings are shuffled twice, for the counts and for the
    # tokens that lines share, and only what they share is worked on after that.
    lines = texts.select("doc", F.posexplode(F.expr(_LINES.format("text"))).alias("k", "line")).withColumn("key", F.expr("unhex(md5(line))"))
    lines = scratch.save(_prefixes(_tokens(lines, "doc", "k", "key"), "doc", "k", "key"), "lines")
    keys = lines.select("doc", "k", "key")
    firsts = scratch.save(keys.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("c")).filter("c > 1").select("key", "first"), "firsts")
    copies = scratch.save(keys.join(firsts, "key").filter("doc <> first").select("doc", "k"), "copies")
    # Where rows repeat a doc_id, one's copy may stand at the place of another's first line: these stay, to be found again.
    repeated = texts.groupBy("doc").agg(F.count("*").alias("c")).filter("c > 1").select("doc")
    lists = scratch.save(copies.join(repeated, "doc", "left_anti").groupBy("doc").agg(F.collect_set("k").alias("copied")), "copied")
    own = lines.join(_side(lists, "copied"), "doc", "left").filter("copied IS NULL OR NOT array_contains(copied, k)")
    own = scratch.save(own.select("doc", "k", "n", "prefix"), "own")
    scratch.drop(lines, firsts, lists)
    postings = _postings(own)
    # Map-side sums come first: a token that a third of all lines post is one row of each task.
    counts = scratch.save(postings.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    moved, again = _by_rarity(postings, counts, texts, scratch)
    wanted = counts.select("token")
    if again is not None:
        wanted = scratch.save(wanted.union(again.select("token")).distinct(), "wanted")
    stay = scratch.save(postings.join(wanted, "token"), "stay")
    scratch.drop(own, counts, wanted)
    shared = stay
    if again is not None:
        shared = scratch.save(_without(stay, moved, moved.count()).unionByName(again), "shared")
        scratch.drop(stay, moved, again)
    groups = shared.groupBy("token").agg(F.count("*").alias("c"), F.min("doc").alias("hub")).filter("c > 1").select("token", "hub")
    grouped = scratch.save(shared.join(groups, "token"), "grouped")
    scratch.drop(shared)
    shared = grouped
    y = shared.selectExpr("token", "hub", "doc", "k", "n AS n_y", "p AS p_y")
    x = shared.selectExpr("token", "doc AS x_doc", "k AS x_k", "n AS n_x", "p AS p_x", "hub AS x_hub")
    later = "(x_doc < doc OR x_doc = doc AND x_k < k)"
    hubs = x.filter("x_doc = x_hub").groupBy("token").agg(F.expr("min_by(struct(x_doc, x_k, n_x, p_x), x_k)").alias("h")).select("token", "h.*")
    star = y.join(hubs, "token").filter(f"{later} AND {_FILTERS}").select("x_doc", "x_k", "doc", "k").distinct()
    gone, known = _round(star, None, texts, scratch)
    rest = y.join(gone, ["doc", "k"], "left_anti").join(x, "token").filter(f"{later} AND {_FILTERS}").select("x_doc", "x_k", "doc", "k").distinct()
    more, _ = _round(rest.join(star, ["x_doc", "x_k", "doc", "k"], "left_anti"), known, texts, scratch)
    out = scratch.save(copies.select("doc", "k").union(gone).union(more).groupBy("doc").agg(F.collect_set("k").alias("gone")), "gone")
    scratch.close(out)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that stays, and n_lines and n_removed_lines (in place of columns of these names)."""
    doc, gone, u, n, kept = unused(docs, "_doc", "_gone", "_u", "_n", "_kept")
    lines = _side(removed_lines(docs, doc_id, text), "gone").select(F.col("doc").alias(doc), F.col("gone").alias(gone))
    all_lines = rf"size(filter(split(coalesce(`{text}`, ''), '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]'))"
    at = docs.join(lines, F.col(doc_id).cast("bigint") == F.col(doc), "left").withColumns({u: F.expr(_LINES.format(f"`{text}`")), n: F.expr(all_lines)})
    at = at.withColumn(kept, F.expr(f"CASE WHEN size({u}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE array_except(sequence(0, size({u}) - 1), coalesce({gone}, array())) END"))
    new = {
        text: F.expr(f"CASE WHEN size({kept}) = {n} THEN `{text}` ELSE array_join(transform({kept}, i -> {u}[i]), '\\n') END"),
        "n_lines": F.expr(f"CAST({n} AS BIGINT)"),
        "n_removed_lines": F.expr(f"CAST({n} - size({kept}) AS BIGINT)"),
    }
    return at.withColumns(new).drop(doc, gone, u, n, kept)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, line, i, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT line, ws, min((doc_id, i)) AS place FROM f GROUP BY line, ws),
t AS (SELECT line, place, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END) AS token FROM u),
n AS (SELECT line, count(*) AS n FROM t GROUP BY line),
o AS (SELECT a.line AS x, b.line AS y, count(*) AS o FROM t a JOIN t b ON a.token = b.token AND a.place < b.place GROUP BY a.line, b.line),
s AS (SELECT DISTINCT y AS line FROM o JOIN n nx ON nx.line = o.x JOIN n ny ON ny.line = o.y WHERE 4 * o >= 3 * (nx.n + ny.n - o)),
k AS (SELECT f.doc_id, f.i, f.line, (u.place = (f.doc_id, f.i) AND s.line IS NULL) AS kept FROM f JOIN u ON u.line = f.line LEFT JOIN s ON s.line = f.line),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT kept) AS r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed_lines,
       sha256(CASE WHEN coalesce(r, 0) = 0 THEN coalesce(d.text, '') ELSE g.text END) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {"op10_line_dedup": ORACLE}
