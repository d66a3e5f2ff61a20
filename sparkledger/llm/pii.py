"""PII surrogates: every detected entity gets a keyed replacement of its own type, script, gender and format.

Detected are e-mail and IPv4 addresses, card or account numbers, social
security and phone numbers, names after a form of address, and capitalised
mentions of such a name, or of its last word, anywhere else in the text.  A
surrogate is a keyed permutation of all values of the entity's shape: digits
become digits, letters of an address vowels and consonants of the same script
and case, numbers that pass the Luhn check pass it again, private addresses
stay private.  The words of a name are numbered within all words of their
alphabet, permuted, and written in syllables of the same script, a given name
with an ending of the gender that the form of address tells; a given name of a
list becomes one of the same list.  A permutation cannot map two entities to
one, and it maps an entity to the same surrogate in every document, so
distinctness and coreference hold over the corpus without shared state.
``replace`` checks both within each document all the same: a surrogate that
another entity has already is drawn again.  Spelling is compared without case
(e-mail, names), kind of space or digit, or separators (numbers; a leading plus
counts); the surrogate takes on the spelling of each mention.

Null text stays null and has no entities, as does empty text; repeated rows
give repeated results; an empty table gives an empty table; other columns pass
through, and ones named ``entities`` are replaced.  Text is scanned whole; of
overlapping mentions the earlier one, then the longer one counts.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

# Forms of address by gender, given names by gender and script, vowels by script.
ADDRESS = {
    "m": "Mr Sir Herr Monsieur Señor Sr Don господин г-н",
    "f": "Mrs Ms Miss Lady Frau Madame Mme Señora Sra Doña госпожа г-жа",
    "": "Dr Prof Dra",
}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Mark Peter Hans Karl Pierre Jean Luis Carlos Miguel Pedro Antonio",
    ("f", "latin"): "Mary Anna Linda Susan Karen Sarah Emma Laura Julia Alice Helen Petra Ingrid Marie Claire Sofia Carmen Elena Lucia Isabel",
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
}
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "accents": ("áàâäãåéèêëíìîïóòôöõúùûü", "çñßšžýÿ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρσςτφχψ"),
    "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"),
}
SYLLABLES = {
    "latin": ("bcdfghjklmnprstvwxyz", "aeiou"),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιου"),
    "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоу"),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz'-", "greek": "αβγδεζηθικλμνξοπρσςτυφχψω'-", "cyrillic": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя'-"}
# No syllable ends in a consonant, so what follows the syllables of a word can be told from them: a mark of the alphabet that
# its letters were numbered in, and the ending of a given name.
MARKS = {"latin": ("", "l", "x"), "greek": ("", "λ", "ξ"), "cyrillic": ("", "л", "х")}
ENDINGS = {"latin": {"m": "rdo", "f": "nna", "": ""}, "greek": {"m": "ρδος", "f": "ννα", "": ""}, "cyrillic": {"m": "рдин", "f": "нна", "": ""}}
CLASSES = [*(x for pair in LETTERS.values() for x in pair), "0123456789"]
_CLASS = {c: (k, i) for k, chars in enumerate(CLASSES) for i, c in enumerate(chars)}
_GENDER = {w.lower(): g for g, words in ADDRESS.items() for w in words.split()}
_NAMES = {n.lower(): key for key, names in GIVEN.items() for n in names.split()}

_FORMS = "|".join(sorted((re.escape(w) for words in ADDRESS.values() for w in words.split()), key=len, reverse=True))
_CAPITAL = "".join(c for c in map(chr, [*range(0x530), *range(0x1E00, 0x2000)]) if unicodedata.category(c) == "Lu")
# A word of a name has up to 64 letters; an English genitive is not part of it.
_WORD = rf"[{_CAPITAL}]\w{{0,63}}+(?:['’-](?!s\b)\w{{1,63}}+)*+(?!\w)"
NAME_WORD = re.compile(rf"(?<![\w-]){_WORD}")
_GAP = re.compile(r"[ \xa0]{1,3}")
ENTITY = re.compile(
    r"(?P<email>(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))"
    rf"|(?P<address>\b(?i:{_FORMS})\.?[ \xa0]+)(?P<name>{_WORD}(?:[ \xa0]{{1,3}}{_WORD}){{0,2}})"
)


class Permutation:
    """Keyed permutation of 0 .. size - 1 without fixed points: a Feistel network, a step of one, and the network back."""

    ROUNDS = 6

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode() + b"\0" + str(size).encode()

    def _f(self, r: int, x: int) -> int:
        n = (self.half + 7) // 8
        out, i = b"", 0
        while len(out) < n:
            out += hashlib.blake2b(bytes([r, i]) + x.to_bytes(n, "big") + self.tweak, key=self.key, digest_size=64).digest()
            i += 1
        return int.from_bytes(out[:n], "big") & self.mask

    def _walk(self, x: int, back: bool) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
                a, b = (b ^ self._f(r, a), a) if back else (b, a ^ self._f(r, b))
            x = a << self.half | b
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk((self._walk(x, False) + 1) % self.size, True)


def permute_shape(text: str, key: bytes, kind: str, allowed=None) -> str:
    """text with its letters and digits replaced within their classes; allowed: a property that text has and keeps."""
    places = [(i, *_CLASS[c]) for i, c in enumerate(text) if c in _CLASS]
    size, value = 1, 0
    for _, k, at in places:
        value = value * len(CLASSES[k]) + at
        size *= len(CLASSES[k])
    shape = "".join("abcdefghijklmnopqrstuvwxyz"[_CLASS[c][0]] if c in _CLASS else c for c in text)
    turn = Permutation(key, f"{kind}:{shape}", size)
    while True:
        value = turn(value)
        chars, rest = list(text), value
        for i, k, _ in reversed(places):
            rest, at = divmod(rest, len(CLASSES[k]))
            chars[i] = CLASSES[k][at]
        out = "".join(chars)
        if allowed is None or allowed(out):
            return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _ip_class(value: int) -> int:
    for k, (net, bits) in enumerate(((10 << 24, 8), (127 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (0, 8), (224 << 24, 3))):
        if value >> (32 - bits) == net >> (32 - bits):
            return k
    return -1


def _digits(text: str) -> str:
    """The text with decimal digits of any script as ASCII."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity have in common."""
    if kind == "name":
        return " ".join(_GAP.split(mention.lower()))
    mention = _digits(mention)
    if kind in ("email", "ip"):
        return mention.lower()
    return ("+" if mention.startswith("+") else "") + "".join(c for c in mention if c.isdigit())


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of a canonical value that is no name."""
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.rsplit(".", 1)
        return permute_shape(local, key, "local") + "@" + permute_shape(labels[0], key, "domain") + "." + labels[1]
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n << 8 | int(x)
        turn, net = Permutation(key, "ip", 1 << 32), _ip_class(n)
        if net < 0:
            n = turn(n)
            while _ip_class(n) >= 0:
                n = turn(n)
        else:
            bits = 32 - (8, 8, 12, 16, 8, 3)[net]
            n = n >> bits << bits | Permutation(key, f"ip{net}", 1 << bits)(n & ((1 << bits) - 1))
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        valid = luhn(value)
        return permute_shape(value, key, kind, lambda x: luhn(x) == valid)
    return permute_shape(value, key, kind)


def compose(word: str, key: bytes, role: str, ending: str = "") -> str:
    """A word of syllables for a word of a name, in its script; different words of a role and ending get different ones."""
    script = "cyrillic" if re.search("[\u0400-\u052f]", word) else "greek" if re.search("[\u0370-\u03ff\u1f00-\u1fff]", word) else "latin"
    consonants, vowels = SYLLABLES[script]
    small = {c: i for i, c in enumerate(ALPHABETS[script])}
    if all(c in small for c in word):
        mark, size, letters = 0, len(small), [small[c] for c in word]
    elif all(c < "\u0250" for c in word):
        mark, size, letters = 1, 0x250, [ord(c) for c in word]
    else:
        mark, size, letters = 2, 0x110000, [ord(c) for c in word]
    value = 0  # the word's number among all words, the shorter ones first; its successor bounds the words of its length
    for x in letters:
        value = value * size + x + 1
    base, words = len(consonants) * len(vowels), (size ** (len(word) + 1) - 1) // (size - 1)
    n = max(1, int((words.bit_length() - 1) / math.log2(base)))
    while base**n < words:
        n += 1
    value = Permutation(key, f"{role}:{script}:{mark}", base**n)(value)
    out = ""
    for _ in range(n):
        value, at = divmod(value, base)
        out += consonants[at // len(vowels)] + vowels[at % len(vowels)]
    return out + MARKS[script][mark] + (ENDINGS[script][ending] if ending else "")


def given_name(word: str, key: bytes, gender: str) -> str:
    if word in _NAMES:
        pool = GIVEN[_NAMES[word]].lower().split()
        return pool[Permutation(key, "given" + "".join(_NAMES[word]), len(pool))(pool.index(word))]
    return compose(word, key, "given", gender)


def _dressed(kind: str, mention: str, new: str) -> str:
    """The surrogate in the spelling of the mention."""
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind == "name":
        words = iter(new.split())
        parts = re.split(r"([ \xa0]+)", mention)
        return "".join(x if i % 2 else _cased(x, next(words)) for i, x in enumerate(parts))
    zero = next((ord(c) - unicodedata.decimal(c) for c in mention if c.isdecimal()), 48)
    if kind == "ip":
        return "".join(chr(zero + int(c)) if c.isdigit() else c for c in new)
    digits = iter(new.lstrip("+"))
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(digits))) if c.isdecimal() else c for c in mention)


def _cased(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:]


class Draws:
    """The surrogates of one document: an entity keeps its own, and none is given twice."""

    def __init__(self, key: bytes):
        self.key, self.to, self.fro = key, {}, {}

    def __call__(self, kind: str, value: str, draw) -> str:
        if (kind, value) not in self.to:
            turn, key = 0, self.key
            while self.fro.setdefault((kind, new := draw(value, key)), value) != value:
                turn += 1
                key = self.key + turn.to_bytes(4, "big")
            self.to[kind, value] = new
        return self.to[kind, value]


def _country(mention: str) -> int:
    """Digits of a phone number's country code, which stays."""
    found = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{7})", mention)
    return len(found[1]) if found else 0


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of all entities, in order."""
    found, names, last_words = [], {}, set()
    for m in ENTITY.finditer(text):
        if m.lastgroup != "name":
            found.append((*m.span(), m.lastgroup, ""))
            continue
        gender = _GENDER.get(m["address"].strip(" \xa0.").lower(), "")
        found.append((*m.span("name"), "name", gender))
        words = canonical("name", m["name"]).split()
        last_words.add(words[-1])
        names.setdefault(words[0], set()).add(tuple(words))
    if not names:
        return found
    every, taken, i, more = list(NAME_WORD.finditer(text)), iter([*found, (len(text), len(text), "", "")]), 0, []
    low, high, *_ = next(taken)
    while i < len(every):
        start = every[i].start()
        while high <= start and low < len(text):
            low, high, *_ = next(taken)
        best = 1 if every[i].group().lower() in last_words else 0
        for words in names.get(every[i].group().lower(), ()):
            at = every[i : i + len(words)]
            if len(at) == len(words) and tuple(x.group().lower() for x in at) == words and all(_GAP.fullmatch(text, a.end(), b.start()) for a, b in zip(at, at[1:])):
                best = max(best, len(words))
        end = every[i + best - 1].end() if best else start
        if best and not (low < end and start < high):
            more.append((start, end, "name", ""))
        i += max(best, 1)
    return sorted(found + more)


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and its entities (kind, start, end in the text given, surrogate)."""
    out, last, records, draws, genders = [], 0, [], Draws(key), {}
    found = mentions(text)
    for start, end, kind, gender in found:
        if kind == "name" and gender:
            genders.setdefault(canonical(kind, text[start:end]).split()[0], gender)
    for start, end, kind, _ in found:
        mention = text[start:end]
        value = canonical(kind, mention)
        if kind == "name":
            *given, family = value.split()
            new = " ".join([draws("given", w, lambda x, k: given_name(x, k, genders.get(x, ""))) for w in given] + [draws("family", family, lambda x, k: compose(x, k, "family"))])
        elif value.startswith("+"):
            n = 1 + _country(_digits(mention))
            new = draws(kind, value, lambda x, k, n=n: x[:n] + surrogate("phone", x[n:], k))
        else:
            new = draws(kind, value, lambda x, k, kind=kind: surrogate(kind, x, k))
        dressed = _dressed(kind, mention, new)
        out += [text[last:start], dressed]
        records.append({"kind": kind, "start": start, "end": end, "surrogate": dressed})
        last = end
    out.append(text[last:])
    return "".join(out), records


_ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])
ENTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surrogate", T.StringType())]))


def anonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """df with surrogates in its text, and its entities."""
    keep = [c for c in df.columns if c.lower() != "entities"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("entities", ENTITIES)])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            pairs = [(None, []) if x is None else replace(x, key) for x in batch.column(at(text)).to_pylist()]
            arrays = [pa.array([p[0] for p in pairs], pa.string()) if c == text else batch.column(at(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([p[1] for p in pairs], pa.list_(_ENTITY))], names=[*keep, "entities"])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Key of the registered query; production passes its own.
DEMO_KEY = b"sparkledger surrogate key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), "text", F.expr("array_join(transform(entities, e -> concat(e.kind, ':', e.start, ':', e.end)), ',')").alias("spans"))


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates}
SQL: dict[str, str] = {}
