import numpy as np
from helpers import plain_words, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import hashing


def found_words(text):
    data, _ = hashing.join_texts([text])
    starts, ends, hashes = hashing.words(data)
    folded = data.translate(bytes(hashing.WORD_BYTES))
    return [folded[a:b].decode() for a, b in zip(starts, ends)], hashes


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_are_those_of_the_pattern(text):
    assert found_words(text)[0] == plain_words(text)


def test_hashes_do_not_depend_on_place(monkeypatch):
    text = prose(5, 500)
    whole = found_words(text)
    monkeypatch.setattr(hashing, "PIECE", 100)
    cut = found_words("Some, other WORDS! " + text)
    assert cut[0][3:] == whole[0] and (cut[1][3:] == whole[1]).all()
    assert len(set(whole[1].tolist())) == len(set(whole[0]))


def test_windows_depend_on_order():
    a = np.array([1, 2, 3], np.uint64)
    assert hashing.windows(a, 3)[0] != hashing.windows(a[::-1].copy(), 3)[0]
    assert len(hashing.windows(a, 4)) == 0
