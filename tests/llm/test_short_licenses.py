"""Short license templates with every one or two of their words changed, against full alignment."""

import itertools

import pytest

from quillon.llm import licenses
from quillon.llm.decontam import plain_words
from quillon.llm.shingles import word_hashes

INDEX = licenses.Templates(licenses.TEMPLATES)
SHORT = [n for n in sorted(licenses.TEMPLATES) if len(plain_words(licenses.TEMPLATES[n])) <= 14]


@pytest.mark.parametrize("name", SHORT)
def test_every_single_and_double_change(name):
    ws = [w.decode() if isinstance(w, bytes) else w for w in plain_words(licenses.TEMPLATES[name])]
    own = word_hashes(plain_words(licenses.TEMPLATES[name]))
    for r in (0, 1, 2):
        for places in itertools.combinations(range(len(ws)), r):
            text = "before it " + " ".join("changed" if i in places else w for i, w in enumerate(ws)) + " after it"
            n, *_ = licenses.align(own, word_hashes(plain_words(text)), 0, None)
            got = [x["n_matched"] for x in INDEX.scan(text, licenses.PERCENT) if x["license"] == name]
            assert got == ([n] if 100 * n >= licenses.PERCENT * len(own) else []), (name, text)


def test_a_changed_word_in_the_middle_of_the_shortest_notice():
    assert [x["license"] for x in INDEX.scan("Released under an MIT License", 80)] == ["MIT-notice"]
