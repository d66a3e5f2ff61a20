"""Surrogates against a brute-force replacer, and with collisions forced by a small space."""

import itertools
import random
import re

from helpers import LONG, edge

from sparkledger.llm import pii

PEOPLE = [("Mr", "John", "Smith"), ("Ms", "Ingeborg", "Łukasz"), ("Frau", "Petra", "Šimonová"), ("господин", "Иван", "Петров"), ("Dr", "", "O'Neill"), ("Κ", "", "")][:5]


def test_mentions_and_coreference_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        people = rng.sample(PEOPLE, 2)
        parts = []
        for _ in range(rng.randint(1, 8)):
            form, first, last = rng.choice(people)
            gap = rng.choice([" ", "\xa0", "  "])
            parts.append(rng.choice([f"{form}{gap}" + (f"{first}{gap}" if first else "") + last, (f"{first}{gap}" if first else "") + last, last, last.upper(), "nobody here", "a.b@c.example", "10.0.0.7"]))
        text = " came, and ".join(parts)
        new, found = pii.replace(text, b"k")
        # A person is found if some part names them after a form of address; then every capitalised mention goes.
        known = [p for p in people if any(x.replace("\xa0", " ").startswith(p[0] + " ") and x.endswith(p[2]) for x in parts)]
        for form, first, last in known:
            assert not re.search(rf"(?<!\w){re.escape(last)}(?!\w)", new, re.I)
            full = {pii.canonical("name", e["surrogate"]).split()[-1] for e in found if text[e["start"] : e["end"]].lower().endswith(last.lower())}
            assert len(full) == 1
        for e in found:
            assert text[e["start"] : e["end"]] != e["surrogate"]
        back, at = "", 0  # everything else stays
        for e in found:
            i = new.index(e["surrogate"], len(back))
            assert new[len(back) : i] == text[at : e["start"]]
            back, at = new[: i + len(e["surrogate"])], e["end"]
        assert new[len(back) :] == text[at:]


def test_words_of_a_role_stay_distinct():
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("abexz'", repeat=n)] + ["ł" + x for x in "abc"] + ["漢" + x for x in "abc"]
    for ending in ("m", "f", ""):
        assert len({pii.compose(w, b"k", "given", ending) for w in words}) == len(words)
    assert pii.compose("ingeborg", b"k", "given", "f").endswith("nna") and pii.compose("юрий", b"k", "given", "m").endswith("рдин")


def test_collisions_are_drawn_again(monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, key: f"x{sum(value.encode()) * 7 + sum(key) * 13 & 3}@y.example")
    text = "a@b.com c@d.com e@f.com g@h.com and a@b.com"
    new, found = pii.replace(text, b"k")
    given = [e["surrogate"] for e in found]
    assert len(set(given)) == 4 and given[0] == given[4]


def test_digits_spaces_and_plus():
    new, found = pii.replace("call +49 30 1234567, 4930 123 4567, ٠١٢-٣٤-٥٦٧٨ now. Mr John\xa0Smith met Mr John Smith's dog.", b"k")
    assert "٠١٢" not in new and re.search("[٠-٩]{3}-[٠-٩]{2}-[٠-٩]{4}", new) and new.startswith("call +49 ")
    names = [e["surrogate"].replace("\xa0", " ") for e in found if e["kind"] == "name"]
    assert names[0] == names[1] and new.endswith("'s dog.")


def test_long_texts_and_ties(spark):
    text = "Mr John Smith. " + LONG + " Smith and " + "Mr " * 20000 + "X" * 100000
    new, found = pii.replace(text, b"k")
    assert "Smith" not in new and len(found) > 2 and new.endswith("X" * 100000)
    out = pii.anonymise(edge(spark).union(edge(spark)), b"k").collect()
    assert len(out) == 22 and len({(r.doc_id, r.text) for r in out}) <= 11
