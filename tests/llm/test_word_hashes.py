"""A word has one hash, whatever its process hashed before."""

import numpy as np
import pyarrow as pa
import pytest

from sparkledger.llm import substring_dedup, words

PASSAGE = " ".join(f"w{i}" for i in range(30))
#: Beyond the 64 powers that are there from the start.
ODD = "x" * 65


def hashes(text):
    return words.split_words(*words.text_buffers(pa.array([text]))).hashes.tolist()


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", words._POWERS[:64])


def test_long_words_change_no_hash(fresh):
    before = hashes("ab ba word")
    hashes(ODD)
    assert hashes("ab ba word") == before and len(set(before)) == 3


def test_word_hash_is_the_polynomial_of_its_bytes(fresh):
    with np.errstate(over="ignore"):
        p = words._BYTE[ord("a")] + words._BYTE[ord("b")] * words._BASE
        assert hashes("ab") == [int(words.mix(np.array([p + np.uint64(2)]))[0])]


def test_passages_are_found_beside_long_words(spark):
    """The long word lies in another batch of the same worker, between the two passages."""
    rows = [(i, PASSAGE if i in (0, 599) else ODD if i == 300 else f"t{i}") for i in range(600)]
    rows_, cuts = substring_dedup.dedup(spark.createDataFrame([(d, t + (" end" if d == 599 else "")) for d, t in rows], "doc_id long, text string").coalesce(1))
    assert [(r.doc, r.n_removed) for r in cuts.collect()] == [(599, 30)]
