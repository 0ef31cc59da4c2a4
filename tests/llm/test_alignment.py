import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import alignment, bpe, incidence
from canvasser.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATHS = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
A = tokenizers.Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
PLAIN = bpe.Vocabulary(bpe.without_special(open(PATHS[0], encoding="utf-8").read()))
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def dense(m):
    out = np.zeros((m.height, m.width), np.int64)
    for r in range(m.height):
        for k in range(m.starts[r], m.starts[r + 1]):
            out[r, m.columns[k]] += m.values[k]
    return out


def sparse(full):
    full = np.array(full, np.int64)
    at = [np.flatnonzero(row) for row in full]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int64)
    return incidence.Rows(starts, np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *(row[x] for row, x in zip(full, at))]), full.shape[1])


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(1, 5), st.randoms(use_true_random=False), st.integers(1, 8))
def test_products(n, k, m, rnd, step):
    a, b = ([[rnd.choice([0, 0, 1, 2]) for _ in range(w)] for _ in range(h)] for h, w in ((n, k), (k, m)))
    kept, incidence.STEP = incidence.STEP, step
    try:
        got = sparse(a) @ sparse(b)
    finally:
        incidence.STEP = kept
    assert (dense(got) == np.array(a) @ np.array(b)).all()
    assert (dense(sparse(a).transposed()) == np.array(a).T).all()
    vector = np.arange(1, k + 1)
    assert (sparse(a).times(vector) == np.array(a) @ vector).all()


def spans_of(sizes):
    ends = np.cumsum(sizes)
    return [set(range(e - s, e)) for s, e in zip(sizes, ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_alignment_of_ranges(sizes_a, rnd):
    left, sizes_b = sum(sizes_a), []
    while left:
        sizes_b.append(rnd.randint(1, min(5, left)))
        left -= sizes_b[-1]
    found = alignment.Alignment.of(np.array(sizes_a), np.array(sizes_b))
    a, b = spans_of(sizes_a), spans_of(sizes_b)
    assert (dense(found.overlaps) == [[len(x & y) for y in b] for x in a]).all()
    assert (dense(found.links) == [[int(max(x) == max(y)) for y in b] for x in a]).all()
    assert found.shared().tolist() == [sum(g == h for h in found.group_b) for g in found.group_a]
    cuts = sorted({max(x) for x in a} & {max(y) for y in b})
    assert found.group_a.tolist() == [sum(c < max(x) for c in cuts) for x in a]
    assert found.group_b.tolist() == [sum(c < max(x) for c in cuts) for x in b]


def tokens_of(text):
    """Ids and bytes of both sides by the libraries alone; nothing where they differ."""
    if not text:
        return [], [], [], []
    letters = {c: b for b, c in bpe.byte_letters().items()}
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a = [bytes(letters[c] for c in A.id_to_token(i)) for i in ids_a]
    b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    return (ids_a, a, ids_b, b) if b"".join(a) == raw == b"".join(b) else ([], [], [], [])


def brute_force(rows):
    seen, counts = [], Counter()
    for row in rows:
        ids_a, a, ids_b, b = tokens_of(row[1])
        ends_a, ends_b = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
        links = [(i, j) for i, e in zip(ids_a, ends_a) for j, f in zip(ids_b, ends_b) if e == f] if len(a) < 3000 else None
        if links is None:
            of = dict(zip(ends_b, ids_b))
            links = [(i, of[e]) for i, e in zip(ids_a, ends_a) if e in of]
        both = sorted(set(ends_a) & set(ends_b))
        text, p, q = [], 0, 0
        for end in both:
            x, y = [], []
            while p < len(ends_a) and ends_a[p] <= end:
                x.append(str(ids_a[p]))
                p += 1
            while q < len(ends_b) and ends_b[q] <= end:
                y.append(str(ids_b[q]))
                q += 1
            text.append(",".join(x) + "|" + ",".join(y))
        seen.append((row[0], len(a), len(b), len(both), links, hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""))
        counts.update(links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(k, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for k, n_a, n_b, n_g, links, sha in seen]


@pytest.mark.parametrize("most", [alignment.TABLE, 25, 0])
def test_against_the_libraries(documents, none, most):
    rows = odd_rows() + [(20, "a▁b", "en", "s", 3), (21, " two  blanks\t\r\n\x00 ", "en", "s", 0), (22, "<s></s><unk><|endoftext|>", "en", "s", 0), (23, "ﬁne   \xa0x", "en", "s", 0), *((k, prose(k, 40), "en", "s", 0) for k in range(30, 60))]
    got = alignment.report(clashing(documents(rows)).repartition(3), *PATHS, most=most).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(brute_force(rows), key=str)
    assert all(r.n_overlaps >= r.n_links and r.n_shared >= max(r.n_a, r.n_b) for r in got)
    assert alignment.report(none, *PATHS, most=most).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\t'sdtrevml<|endoftext|>aaAé漢  \x1c\x85\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=6))
def test_remembered_ids_are_those_of_the_library(texts):
    for most in (3, 400_000):
        own = bpe.Remembered(PLAIN, most)
        for _ in range(2):
            ids, counts = own.encode(texts)
            assert ids.tolist() == [i for t in texts for i in A.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)


def test_pieces_do_not_change_results(documents, monkeypatch):
    rows = [(k, prose(k, 30 + 7 * k) if k % 5 else None, "en", "s", 0) for k in range(25)]
    monkeypatch.setattr(alignment, "PIECE", 150)
    got = alignment.report(documents(rows), *PATHS).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(brute_force(rows), key=str)
