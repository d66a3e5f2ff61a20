"""Notices that a license scan must not lose."""

import random
import textwrap

import pytest

from sparkledger.llm import licenses

PROSE = (
    "When the results of the survey were published in the spring, several of the authors agreed that the conditions of the work had been subject to many "
    "limitations, and that any person or group of people who wanted to copy the method would have to obtain the files from the office and publish the differences. "
    "In general the office was willing to provide copies of the documents for this purpose, provided that the use was not for sale and that no other parts of the "
    "collection were included, in whole or in part, without a written request to the head of the office and the foundation. "
)


@pytest.mark.parametrize(("notice", "name"), [("All rights reserved.", "reserved"), ("Released under the MIT License.", "MIT")])
def test_a_notice_at_the_end_of_a_long_line(notice, name):
    assert [x[2] for x in licenses.licenses(PROSE + notice)] == [name]


@pytest.mark.parametrize("gap", ["\n", " "])
@pytest.mark.parametrize("first", [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("All rights reserved.", "reserved"), ("Released under the MIT License.", "MIT")])
def test_two_notices_side_by_side(first, gap):
    text = first[0] + gap + "Released under the MIT License."
    got = licenses.licenses(text)
    assert [x[2] for x in got] == [first[1], "MIT"]
    assert [text[x[0] : x[1]] for x in got] == [first[0].rstrip("."), "Released under the MIT License"]
    assert [x[4] for x in got] == [len(licenses.words(first[0])), 5] and {x[5] for x in got} == {""}


def test_the_longer_of_nested_templates_wins():
    assert [x[2] for x in licenses.licenses(licenses.TEMPLATES["Apache-2.0-header"])] == ["Apache-2.0-header"]


def test_stretches_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        template = [rng.choice("abcdefg") for _ in range(rng.randint(3, 12))]
        block = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))] + template[: rng.randint(0, 12)] + template + [rng.choice("abc") for _ in range(rng.randint(0, 6))]
        del block[rng.randrange(len(block))]
        want = set()
        for i in range(len(block)):
            for j in range(i + 1, len(block) + 1):
                n = licenses.wording(template, block[i:j])[0]
                if n >= licenses.MATCHED * len(template) and j - i - n <= licenses.FOREIGN * (j - i) and block[i] in template and block[j - 1] in template:
                    want.add((n, i, j))
        assert set(licenses.stretches(template, block)) == want


@pytest.mark.parametrize("name", ["MIT-text", "Apache-2.0-header", "BSD-3-Clause", "GPL-3.0-header"])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("width", [30, 78])
def test_wrapped_texts(name, mark, width):
    lines = textwrap.wrap(licenses.TEMPLATES[name], width, break_long_words=False, break_on_hyphens=False)
    lines[len(lines) // 2 : len(lines) // 2] = [""]  # a blank line within
    text = "import sys\n\n" + "\n".join(mark + x for x in lines) + "\n\nprint(1)\n"
    (got,) = licenses.licenses(text)
    assert got[2] == name and got[4] == len(licenses.words(licenses.TEMPLATES[name])) and got[5] == ""
    assert licenses.words(text[got[0] : got[1]]) == licenses.words(licenses.TEMPLATES[name])


def test_copies_far_apart_and_close_together():
    wrapped = "\n".join(textwrap.wrap(licenses.TEMPLATES["MIT-text"], 60))
    assert [x[2] for x in licenses.licenses(wrapped + "\n\n" + wrapped + "\nword" * 2000 + "\n" + wrapped)] == ["MIT-text"] * 3


def test_versions_decide():
    for version, name in (("2", "GPL-2.0"), ("3", "GPL-3.0")):
        got = licenses.licenses(f"This work is licensed under the GNU General Public License, version {version}.")
        assert [x[2] for x in got] == [name] and got[0][5] == ""
    assert licenses.licenses("This work is licensed under the GNU General Public License, version 9.") == []


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# "])
@pytest.mark.parametrize("width", [60, 76, 100])
def test_every_template_is_found_wrapped(mark, width):
    for name, text in licenses.TEMPLATES.items():
        lines = textwrap.wrap(text, width - len(mark))
        got = licenses.licenses("Some prose above it here.\n" + "\n".join(mark + x for x in lines) + "\nand some below.")
        assert name in [x[2] for x in got], (name, got)
