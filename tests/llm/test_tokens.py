import hashlib

import numpy as np
import pytest
from helpers import clashing, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import bpe, bpe_tables, token_counts
from canvasser.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\t'sdtrevml<|endoftext|>aaAé漢  \x1c\x85\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_those_of_the_library(text):
    ids, counts = OWN.encode(OWN.split(text))
    assert ids.tolist() == ids_of(text) and counts.sum() == len(ids)
    ids, counts = OWN.encode_units(OWN.units(text))
    assert ids.tolist() == ids_of(text) and counts.sum() == len(ids)


@settings(max_examples=400, deadline=None)
@given(st.text("  \n\n\tab.1'sé", max_size=14))
def test_units_keep_the_pre_tokens(text):
    assert [t for u in OWN.units(text) for t in OWN.tokens_of(u)] == OWN.split(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 999, "aaab" * 700 + "\n\n", "<|endoftext|>" * 3, "x<|endoftext|>y", " " * 50])
def test_long_and_repeated(text):
    assert OWN.encode(OWN.split(text))[0].tolist() == ids_of(text)


def test_counts(documents, none, monkeypatch):
    got = token_counts.token_counts(clashing(documents(odd_rows())), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids_of(r[1])), len(ids_of(r[1])) > 1024) for r in odd_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(none, PATH).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    seen: dict = {}
    for k in range(4):
        text = prose(k, 120)
        assert token_counts._counts([text, "", text], OWN, seen).tolist() == [len(ids_of(text)), 0, len(ids_of(text))]
        assert len(seen) <= 50


@pytest.mark.parametrize("table_bytes", [bpe_tables.TABLE_BYTES, 30_000, 0])
def test_round_trip(documents, none, table_bytes):
    got = bpe_tables.round_trip(clashing(documents(odd_rows())), PATH, table_bytes=table_bytes).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r[0], len(i := ids_of(r[1])), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for r in odd_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_tables.round_trip(none, PATH, table_bytes=table_bytes).count() == 0


def test_words_of_one_hash_are_told_apart():
    """A table whose hash belongs to another word does not give that word's ids."""
    ids, counts = OWN.encode_units(["house", "\tfirst"])
    for word, other in (("house", "mouse"), ("house", "houses"), ("\tfirst", "\tthirst")):
        k = 0 if word == "house" else 1
        mine = ids[: counts[0]] if k == 0 else ids[counts[0] :]
        table = (bpe_tables._hashes([other]), np.array([0, len(mine)], np.int32), mine.astype(np.uint16))
        flat, ends, tails, gaps = bpe_tables._positions([OWN.text_of(other).replace(" ", "", 1) if k else "x " + other], OWN, table, True)
        text = OWN.text_of(other) if k else "x " + other
        assert flat.tolist() == ids_of(text)
    right = (bpe_tables._hashes(["house"]), np.array([0, counts[0]], np.int32), ids[: counts[0]].astype(np.uint16))
    assert bpe_tables._positions(["x house"], OWN, right, True)[0].tolist() == ids_of("x house")
    assert [OWN.text_of(u) for u in OWN.units("a b\nc")] == ["a", " b", "\nc"]


def test_decode_any_ids(spark):
    rows = spark.createDataFrame([(1, [50256, 0, 255]), (2, []), (3, None), (4, [10**9, 1])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe_tables.decode(rows, PATH).collect()}
    assert got[1] == LIBRARY.decode([50256, 0, 255], skip_special_tokens=False)
    assert got[2] == "" and got[3] == "" and got[4] == LIBRARY.decode([1])
