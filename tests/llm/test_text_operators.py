"""Operators that map documents one by one."""

import hashlib
import random
import re

import pytest
import tiktoken
from helpers import EDGE, edge, empty

from sparkledger.llm import bpe, decontaminate, html, licenses, pii, quality, secrets
from sparkledger.llm.automaton import Dfa, parse

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def coder():
    return bpe.load(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_matches_the_library(coder, reference):
    rng = random.Random(5)
    texts = ["", " ", "a" * 3000, "x\x1cy \x1f½²Ⅷ٣", "it's 'll'd", "日本語🙂 \n\n  z", "aaab" * 400]
    texts += ["".join(rng.choice("abcde é日\n's🙂½_9") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text, packed in zip(texts, coder.encode_all(texts), strict=True):
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


def test_bpe_lone_and_shared_queue_agree(coder):
    rng = random.Random(6)
    pieces = ["".join(rng.choice("abcehinot") for _ in range(rng.randint(2, 40))).encode() for _ in range(200)]
    pieces = [p for p in pieces if p not in coder.ranks]
    packed = coder.merge_many(pieces)
    assert [b"".join(i.to_bytes(4, "little") for i in coder.merge(p)) for p in pieces] == packed


def test_bpe_frames(spark):
    path, pattern = bpe.default_vocabulary()
    df = edge(spark).selectExpr("*", "'x' AS ids", "1 AS extra")
    out = bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.extra == 1 for r in out) and len(out) == len(EDGE)
    assert bpe.round_trip(empty(spark), path, pattern).count() == 0
    for r in bpe.round_trip(edge(spark), path, pattern).collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def repeats(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)})


def test_quality_counts(spark):
    texts = [(i, t) for i, (_, t) in enumerate(EDGE)] + [(50, "a b c d e f g a b c d e x # $ |\na b\na b\n\n \n"), (51, "x " * 500), (52, "p q r s t p q r s t p q r s t")]
    got = {r.doc_id: r for r in quality.judge(quality.features(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for i, t in texts:
        words = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(lines), len(lines) - len(set(lines)), repeats(words))
        assert r.base_failed == (len(words) < 10 or 100 * repeats(words) > 20 * len(words)) and (not r.kept or not r.base_failed)
    assert quality.judge(quality.features(empty(spark))).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judge(quality.features(docs)).select("quality", "kept", "base_failed").collect()
    clean, junk = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)


KINDS = (
    (re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 6),
    (re.compile(rb"AKIA[A-Z0-9]+"), 20),
    (re.compile(rb"[0-9a-f]+"), 24),
)


def test_secrets_match_regexes(spark):
    rng, scan = random.Random(3), secrets.scanner()
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '="', "='", ": ", "=", "  ", "abc", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef" * 3, "XYZ012345", "é", '"', "\n", ".", "tok", "en"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        data = text.encode()
        wanted = sorted((m.start(), k, m.end()) for k, (r, least) in enumerate(KINDS) for m in r.finditer(data) if len(m[m.lastindex or 0]) >= least)
        assert [x for x in scan.spans(data) if x[1] < 3] == wanted
        assert all(text[a:b].isascii() for kind, a, b in scan.text_spans(text) if kind in ("assign", "access", "hex"))
    kinds = [x[0] for x in scan.text_spans("ghp_" + "a1B2" * 9 + " xoxb-123456789012-abcdef " + "-----BEGIN RSA PRIVATE KEY-----")]
    assert {"forge", "chat", "private"} <= set(kinds)
    assert secrets.scan(empty(spark)).count() == 0 and secrets.scan(edge(spark).selectExpr("*", "1 AS spans")).count() == len(EDGE)


def test_automaton_agrees_with_regexes():
    rng = random.Random(9)
    for pattern in ("a(b|c)*d", "[a-c]{2,}x?", "(ab|a)(c|bcd)", "a.b".replace(".", "\\.") + "|[^ab]c+"):
        dfa, want = Dfa([parse(pattern)], search=False), re.compile(pattern.encode())
        for _ in range(300):
            data = "".join(rng.choice("abcdx.") for _ in range(rng.randint(0, 7))).encode()
            state = dfa.start
            for b in data:
                state = dfa.table[state | b]
            assert (state >= dfa.first_accepting << 8) == bool(want.fullmatch(data)), (pattern, data)


PAGES = {
    "<html><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='sidebar'><p>Side</p></div><div id=content><h1>Title</h1><p>First <a href=x>link</a> text.</p><p>Second &amp; last&nbsp;one <b>bo</b>ld.<div class='ad'>Buy</div><ul><li>one<li>two</ul></div><section id=comments><p>Nice!</p></section><footer>c</footer></body></html>": "Title First link text. Second & last one bold. one two",
    "<body><div class=wrap><div class='cookie-notice'>Cookies.</div><div class=post><h2>T</h2>Direct text<br>after<table><tr><td>c1<td>c2</table></div><form><input><label>N</label></form><aside>r</aside></div>": "T Direct text after c1 c2",
    "<article><header><h1>Head</h1></header><p>x<script>var a='</p>'</script></p><footer>by</footer><div class=comments>no</div></article>": "Head x",
    "<p>one<p>two": "one two",
    "just text": "just text",
    "": "",
    None: "",
    "<nav><a>only</a></nav>": "",
}


def test_html(spark):
    for page, text in PAGES.items():
        assert html.main_text(page) == text
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(PAGES)], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == dict(enumerate(PAGES.values()))


def test_html_takes_whole_articles():
    import pyarrow.parquet as pq
    from html import unescape

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        parts = unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?(?:p|h1)|br)\b[^>]*>", "\x01", inner))).split("\x01")
        assert html.main_text(page) == " ".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in parts) if x)


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_brute_force():
    rng = random.Random(4)
    hits = 0
    for _ in range(250):
        item = decontaminate.normal("".join(rng.choice("abcd ef") for _ in range(rng.randint(5, 80))))
        if not item:
            continue
        changed = list(item)
        for _ in range(rng.randint(0, len(item) // 10 + 2)):
            i = rng.randrange(len(changed) + 1)
            changed[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        text = decontaminate.normal("".join(rng.choice("abcd ef") for _ in range(30)) + "".join(changed) + "".join(rng.choice("abcd ef") for _ in range(30)))
        want = distance(item, text)
        got = decontaminate.Matcher([(7, item)]).matches(text)
        assert ([x[1] for x in got] or [None]) == ([want] if want <= len(item) // 10 else [None])
        hits += bool(got)
    assert hits > 50


def test_decontamination_frames(spark):
    items = spark.createDataFrame([(1, "The quick, brown FOX jumps over the lazy cat and runs away"), (2, None), (3, "!!")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(edge(spark), items).collect()} == {(1, 1), (2, 1), (None, 1)}
    assert decontaminate.clean(edge(spark), items).filter("doc_id IN (1, 2)").count() == 0
    assert decontaminate.clean(edge(spark), items).count() == len(EDGE) - 2
    assert decontaminate.matches(edge(spark), items.limit(0)).count() == 0 and decontaminate.matches(empty(spark), items).count() == 0


def test_surrogates():
    text = "Dear Mr. John Smith and Mrs Anna Müller, MR JOHN SMITH; г-н Иван Петров, call (212) 555-1234 or +49 30 1234567, 10.1.2.3, 4111 1111 1111 1111, a.b@mail.example.com A.B@mail.example.com"
    new, found = pii.replace(text, b"k")
    assert pii.replace(text, b"k") == (new, found) and pii.replace(text, b"other")[0] != new
    for e in found:
        old = text[e["start"] : e["end"]]
        assert old not in new and (e["kind"] == "ip" or re.sub(r"\d", "0", re.sub(r"\w(?<!\d)", "a", old)) == re.sub(r"\d", "0", re.sub(r"\w(?<!\d)", "a", e["surrogate"])) or e["kind"] == "name")
    by = {text[e["start"] : e["end"]]: e["surrogate"] for e in found}
    assert by["JOHN SMITH"] == by["John Smith"].upper() and by["a.b@mail.example.com"] == by["A.B@mail.example.com"]
    assert by["John Smith"].split()[0] in pii.GIVEN["m", "latin"].split() and by["Anna Müller"].split()[0] in pii.GIVEN["f", "latin"].split()
    assert by["Иван Петров"].split()[0] in pii.GIVEN["m", "cyrillic"].split() and by["10.1.2.3"].startswith("10.")
    assert pii.luhn(re.sub(r"\D", "", by["4111 1111 1111 1111"])) and by["+49 30 1234567"].startswith("+49 ")


def test_permutations_are_bijections_without_fixed_points():
    for size in (2, 3, 10, 97, 256, 1000):
        out = [pii.Permutation(b"k", "t", size)(x) for x in range(size)]
        assert sorted(out) == list(range(size)) and all(a != b for a, b in enumerate(out))


def test_surrogate_frames(spark):
    out = pii.anonymise(edge(spark).selectExpr("*", "1 AS entities"), b"k").collect()
    assert [r.text for r in out if r.doc_id == 3] == [None] and len(out) == len(EDGE)
    assert pii.anonymise(empty(spark), b"k").count() == 0


def test_licenses(spark):
    text = "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.\n\nreleased UNDER the  MIT license\nend"
    got = licenses.licenses(text)
    assert [x[2] for x in got] == ["Apache-2.0", "MIT"] and text[got[0][0] : got[0][1]].startswith("Licensed under the Apache")
    assert [x[2] for x in licenses.licenses(licenses.TEMPLATES["MIT-text"])] == ["MIT-text"]
    assert licenses.licenses("We gave permission is all. A licence to kill.") == [] == licenses.licenses(None)
    one = licenses.licenses("This work is licensed under the GNU General Public License, version 3, yes")[0]
    assert one[2] == "GPL-3.0" and licenses.wording(["a", "b", "c"], ["a", "x", "c"]) == (2, ["b"], ["x"])
    assert licenses.scan(edge(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0
