"""Near copies of documents and lines, and what both build on."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, odd_rows, plain_words, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from canvasser.llm import buckets, jaccard, lines
from canvasser.llm.components import components


class Groups:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    draw = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (None, 3)]
    links += [(5000, 5001 + k) for k in range(200)]
    groups = Groups(6000)
    for a, b in links:
        if a is not None:
            groups.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: groups.find(x) for x in ends if groups.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1, 4, 100])
def test_every_pair_meets_once(spark, block):
    rows = [(1, k) for k in range(17)] + [(2, k) for k in range(5)] + [(3, 9)]
    members = buckets.sized(spark.createDataFrame(rows, "key long, item long"))

    def run(batches):
        import pandas as pd

        def work(part):
            found = [(part["key"].iloc[x], part["item"].iloc[x], part["item"].iloc[y]) for a, b in buckets.pairs(part) for x, y in zip(a, b)]
            return pd.DataFrame(found, columns=["key", "a", "b"])

        return buckets.whole_cells(batches, work)

    met = buckets.by_cell(buckets.cells(members, block)).select("key", "i", "j", "chunk", "item").mapInPandas(run, "key long, a long, b long")
    got = Counter((r.key, *sorted((r.a, r.b))) for r in met.collect())
    want = {(k, a, b) for k, n in ((1, 17), (2, 5)) for a in range(n) for b in range(a + 1, n)}
    assert got == Counter(want)


def brute_jaccard(docs):
    sets = []
    for _, text in docs:
        w = plain_words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    groups, links = Groups(len(docs)), Counter()
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    first = defaultdict(lambda: 2**63)
    for k, (doc, _) in enumerate(docs):
        first[groups.find(k)] = min(first[groups.find(k)], 2**63 - 1 if doc is None else doc)
    name = lambda k: None if first[groups.find(k)] == 2**63 - 1 else first[groups.find(k)]
    return sorted(((doc, len(sets[k]), name(k), links[k]) for k, (doc, _) in enumerate(docs)), key=str)


def near(seed, n, changes):
    w = prose(seed, n).split()
    for k in range(changes):
        w[(k * 37 + changes) % n] = f"other{k}"
    return " ".join(w)


NEAR = [near(s, 200, c) for s in range(5) for c in range(12)] + [prose(50 + k, 100) for k in range(20)] + ["one two", "One. Two!", "", None, "lonely"]


@pytest.mark.parametrize("limit, block", [(jaccard.LIMIT, jaccard.BLOCK), (4, 3)])
def test_jaccard_join(documents, limit, block):
    got = jaccard.report(clashing(documents(NEAR)), limit=limit, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_jaccard(list(enumerate(NEAR)))


def test_jaccard_odd_rows(documents, none):
    docs = documents(odd_rows())
    got = jaccard.report(clashing(docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute_jaccard([(r[0], r[1]) for r in odd_rows()])
    kept = jaccard.drop_near(clashing(docs))
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left[(6, prose(1, 80))] == 1 and (7, prose(1, 80)) not in left and left[(4, "one")] == 1 and (5, "one") not in left
    assert left[(None, None)] == 1 and left[(2, "")] == 1 and len(left) == 12 and kept.columns == clashing(docs).columns
    assert jaccard.report(none).count() == 0 and jaccard.drop_near(none).count() == 0


def test_runs_reach_the_recall():
    kept = (1 - 0.2**jaccard.CHILDREN) ** jaccard.DEPTH
    assert 1 - (1 - kept) ** jaccard.runs() >= jaccard.RECALL


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    assert lines.edit_distance(a, b) == row[-1]
    for most in (0, 2, 5):
        cut = lines.edit_distance(a, b, most)
        assert cut == row[-1] if row[-1] <= most else cut > most
    longest = max(len(a), len(b))
    assert lines.similar(a, b) == (longest == 0 or 1 - row[-1] / longest >= 0.8 - 1e-9)


def test_blocks_keep_what_differs_little():
    """Pigeonhole: fewer differing bits than disjoint blocks always leave one block equal."""
    draw = np.random.default_rng(3)
    for items in (10, 10**6, 10**8, 10**11):
        number, width = lines.blocks_for(items)
        assert 1 - (1 - (1 - lines.APART) ** width) ** number >= lines.RECALL
        disjoint = min(number, lines.WIDTH // width)
        differing = np.zeros((50, lines.WIDTH), np.uint8)
        for row in differing:
            row[draw.choice(lines.WIDTH, disjoint - 1, replace=False)] = 1
        got = lines.first_block(differing, number, width)
        places = lines.block_places(number, width)[:, :width]
        want = [min(t for t in range(number) if not row[places[t]].any()) for row in differing]
        assert got.tolist() == want
        assert all(len(set(p.tolist())) == width for p in places)
    assert lines.first_block(np.ones((1, lines.WIDTH), np.uint8), 4, 8).tolist() == [-1]


def test_bucket_rows_hold_the_blocks():
    found = lines.line_items([prose(k, 30) for k in range(40)])
    bits, (number, width) = [found[c] for c in lines.BITS], lines.blocks_for(10**7)
    first, second = (x.reshape(40, number) for x in lines.bucket_rows(found["item"], bits, number, width))
    table, places = lines.unpacked(bits), lines.block_places(number, width)
    assert (first >= 0).all()
    for k in range(40):
        for t in range(number):
            want = sum(int(b) << n for n, b in enumerate(table[k, places[t, :width]]))
            assert int(first[k, t]) >> (lines._ROOM - width) == (t << width) | want
            assert (int(second[k, t]) % 2**64) >> lines._EXTRA == int(found["item"][k]) % 2**lines.NAME_BITS


def line_groups(names, linked):
    groups = Groups(len(names))
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            if linked(names[a], names[b]):
                groups.join(a, b)
    return groups


def test_distances_side_by_side():
    """Pairs of all lengths around the limits of a long, with letters outside the first plane and carries over many longs."""
    draw = np.random.default_rng(5)
    sizes = [1, 2, 62, 63, 64, 65, 127, 128, 129, 300]
    letters = list("ab \u00e9\U0001f600")
    pairs = [("".join(draw.choice(letters, n)), "".join(draw.choice(letters, m))) for n in sizes for m in sizes]
    pairs += [(a, a[:50] + "zz" + a[51:]) for a, _ in pairs[::7]] + [("a" * 400, "a" * 401), ("a" * 400, "b" * 400), ("\ud800x", "x")]
    assert lines.edit_distances(pairs).tolist() == [lines.edit_distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("lanes", [1, 64, 8192])
def test_links_wait_for_the_cheap_ones(monkeypatch, lanes):
    """Components are those of all similar pairs, in whatever order and however many are compared at once."""
    monkeypatch.setattr(lines, "LANES", lanes)
    draw = np.random.default_rng(6)
    texts = [prose(k // 6, 40) for k in range(60)]
    texts = ["".join(c if draw.random() > share else "q" for c in t) for t, share in zip(texts, draw.choice([0.0, 0.05, 0.12, 0.2], 60))]
    names = [lines.normalised(t) for t in [*texts, "a", "b", "ab"]]
    a, b = np.triu_indices(len(names), 1)
    got = lines.link_similar(names, iter([(a[::2], b[::2]), (a[1::2], b[1::2])]), 0.8)
    groups = line_groups(names, lines.similar)
    assert all((got[i] == got[j]) == (groups.find(i) == groups.find(j)) for i, j in zip(a.tolist(), b.tolist()))
    assert all(r <= k for k, r in enumerate(got)) and 5 < len(set(got)) < 63


@pytest.mark.parametrize("width", [8, 14, 15, 21])
def test_rows_near_another_one_of_their_bucket(width):
    """Against all pairs, in buckets of one row to many, whose further bits fill one long or two."""
    draw = np.random.default_rng(width)
    further = lines._ROOM - width
    key = np.sort(draw.choice(40, 300, p=np.arange(1, 41) / 820).astype(np.uint64))
    base = draw.integers(0, 2**63, 300, dtype=np.uint64)
    noise = draw.integers(0, 2**63, 300, dtype=np.uint64) & draw.integers(0, 2**63, 300, dtype=np.uint64) & draw.integers(0, 2**63, 300, dtype=np.uint64)
    base[1::2] = base[::2] ^ noise[1::2]
    first = (key << np.uint64(further)) | (base & np.uint64(2**further - 1))
    second = (base ^ noise[::-1]) & np.uint64(2**64 - 1)
    bits = [(int(a) % 2**further) << lines._EXTRA | int(b) % 2**lines._EXTRA for a, b in zip(first, second)]
    most = lines.SLACK * 0.23 * (further + lines._EXTRA)
    want = [any(i != j and key[i] == key[j] and (bits[i] ^ bits[j]).bit_count() <= most for j in range(300)) for i in range(300)]
    assert lines.near_in_buckets(first, second, width, 0.23).tolist() == want
    assert 0 < sum(want) < 300
    assert lines.near_in_buckets(first[:0], second[:0], width, 0.23).tolist() == []


def brute_lines(docs, linked=lines.similar):
    """docs in order of id; equal (id, text) share their positions."""
    spots = []
    for doc, text in docs:
        own = (text or "").split("\n")
        spots += [(doc, k, name) for k, x in enumerate(own) if (name := lines.normalised(x))]
    first = {}
    for doc, k, line in spots:
        first.setdefault(line, (doc, k))
    names = list(first)
    groups = line_groups(names, linked)
    keep = {}
    for k, line in enumerate(names):
        keep[groups.find(k)] = min(keep.get(groups.find(k), (2**63, 0)), first[line])
    kept_at = {line: keep[groups.find(k)] for k, line in enumerate(names)}
    gone = {(doc, k) for doc, k, line in spots if kept_at[line] != (doc, k)}
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        left = "\n".join(x for k, x in enumerate(own) if (doc, k) not in gone)
        out.append((doc, len(own), sum((doc, k) in gone for k in range(len(own))), hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_line_dedup(documents):
    base = [prose(s, 60) for s in range(12)]
    texts = []
    for k in range(40):
        some = [base[k % 12], "", near(k % 5, 60, 1 + k % 3), prose(100 + k, 20), "The same LINE, again.", " -- ", base[(k * 7) % 12].upper()]
        texts.append("\n".join(some))
    texts += [None, "", "\n\n", "the same line again"]
    want = brute_lines(list(enumerate(texts)))
    for options in ({}, {"block": 3}, {"block": 3, "hot": 16}):
        got = lines.report(clashing(documents(texts)), **options)
        assert sorted(map(tuple, got.collect())) == want
    assert sum(r[2] for r in brute_lines(list(enumerate(texts)))) > 100


def changed(kind, seed, n):
    """A line of n words and one near it, changed in one of four ways."""
    line = prose(seed, n)
    w = line.split()
    some = [k for k in range(n) if k % 9 == seed % 9] or [0]
    if kind == "replaced":
        for k in some:
            w[k] = f"other{k}"
    elif kind == "letters":
        for k in some:
            w[k] = w[k][:2] + "q" + w[k][3:]
    elif kind == "inserted":
        for k in reversed(some):
            w.insert(k, f"new{k}")
    else:
        del w[some[0]]
    return line, " ".join(w)


def test_recall_of_near_lines(documents):
    """Against brute force by edit similarity alone: no pair is made up, and nine of ten are found."""
    pairs = [changed(kind, 40 * n + seed, n) for kind in ("replaced", "letters", "inserted", "dropped") for n in (6, 10, 20, 40, 120) for seed in range(9)]
    texts = [x for pair in pairs for x in pair]
    names = [lines.normalised(t) for t in texts]
    near_pairs = [k for k in range(0, len(texts), 2) if lines.similar(names[k], names[k + 1])]
    assert len(near_pairs) > 0.9 * len(pairs)
    got = {r.doc_id for r in lines.report(documents(texts)).collect() if r.n_removed}
    found = sum(k + 1 in got for k in near_pairs)
    assert found >= lines.RECALL * len(near_pairs)
    true = {b for b in range(len(names)) if any(lines.similar(names[a], names[b]) for a in range(b))}
    assert got <= true
    more = {r.doc_id for r in lines.report(documents(texts), recall=0.9999, reach=0.5).collect() if r.n_removed}
    assert more >= got and len(more) >= 0.97 * len(true) and more <= true


@given(st.text("ab ", max_size=12), st.text("ab ", max_size=12))
def test_middle(a, b):
    x, y = lines._middle(a, b)
    k = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    e = next((e for e, (p, q) in enumerate(zip(a[k:][::-1], b[k:][::-1])) if p != q), min(len(a), len(b)) - k)
    assert (x, y) == (a[k : len(a) - e], b[k : len(b) - e])


def misspelt(text, every):
    """One letter in so many changed."""
    return "".join("q" if k % every == every - 1 and c != " " else c for k, c in enumerate(text))


def test_every_pair_is_compared_on_demand(documents, monkeypatch):
    """Lines misspelt throughout share no block; with ``exact`` they are found like any others, in small cells too."""
    texts = [x for n in (1, 2, 4, 12, 30) for seed in range(4) for x in (prose(70 * n + seed, n), misspelt(prose(70 * n + seed, n), 6))]
    texts += [x for n in (6, 40) for seed in range(4) for x in changed("letters", 300 * n + seed, n)] + [None, "", "漢字", "漢字 x", texts[4]]
    want = brute_lines(list(enumerate(texts)))
    assert sorted(map(tuple, lines.report(documents(texts)).collect())) != want
    assert sorted(map(tuple, lines.report(documents(texts), exact=True).collect())) == want
    monkeypatch.setattr(lines, "EXACT_BLOCK", 3)
    assert sorted(map(tuple, lines.report(documents(texts), exact=True, block=3).collect())) == want
    assert sum(r[2] for r in want) >= 20


def test_line_dedup_of_odd_rows(documents):
    rows = odd_rows()
    got = Counter(map(tuple, lines.report(clashing(documents(rows))).collect()))
    single = [(d, t) for d, t, *_ in rows if d is not None and d not in (6, 10)]
    want = brute_lines([(5, "one"), (7, prose(1, 80))])
    assert len(want) == 2 and got[(5, 1, 1, hashlib.sha256(b"").hexdigest())] == 1 and got[(7, 1, 1, hashlib.sha256(b"").hexdigest())] == 1
    for doc, text in single:
        if doc not in (5, 7):
            assert got[(doc, (text or "").count("\n") + 1, 0, hashlib.sha256((text or "").encode()).hexdigest())] == 1
    assert got[(6, 1, 0, hashlib.sha256(prose(1, 80).encode()).hexdigest())] == 2 and sum(got.values()) == len(rows)


def test_hot_bucket_is_split(documents):
    """Many lines that are near each other, in cells of a few lines."""
    texts = [near(3, 60, 1 + k % 5) + f" tail{k}" for k in range(150)] + [prose(900 + k, 40) for k in range(40)]
    want = brute_lines(list(enumerate(texts)))
    for options in ({"hot": 16, "block": 20}, {}):
        assert sorted(map(tuple, lines.report(documents(texts), **options).collect())) == want
    assert sum(r[2] for r in want) >= 140


def doubled(n):
    """The doubling sequence of 2 ** n letters, and its complement."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_lines_that_clash_under_a_polynomial(documents):
    a, b = doubled(11)
    found = lines.line_items([a, b])
    assert found["item"][0] != found["item"][1]
    assert [r.n_removed for r in lines.report(documents([a, b])).orderBy("doc_id").collect()] == [0, 0]
    sizes = {r.doc_id: r.class_id for r in jaccard.report(documents([a, b])).collect()}
    assert sizes == {0: 0, 1: 1}


def test_line_dedup_odd_rows(documents, none):
    docs = documents(odd_rows())
    frame = clashing(docs)
    out = lines.dedup_lines(frame, mark="gone")
    assert out.columns == [*frame.columns, "gone"] and out.count() == docs.count()
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, list(r.gone)))
    assert got[6] == [(prose(1, 80), [])] * 2 and got[7] == [("", [0])] and got[4] == [("one", [])] and got[5] == [("", [0])]
    assert got[1] == [(None, [])] and got[3] == [("  \n\n ", [])] and sorted(x[0] for x in got[10]) == sorted([prose(4, 50), prose(5, 50)])
    assert lines.report(none).count() == 0


def test_one_measure_at_all_lengths(documents):
    def spoiled(seed, n):
        return " ".join(w[:-1] + "q" if k % 3 == 0 else w for k, w in enumerate(prose(seed, n).split()))

    for n in (30, 150, 700, 3000):
        a, b = prose(n, n), spoiled(n, n)
        assert lines.similar(a, b) and not lines.similar(a, prose(n + 1, n))
        assert lines.similar(a, a + " " + prose(2, n // 10)) and not lines.similar(a, a + " " + prose(2, n // 2))
    pair = [prose(700, 700), spoiled(700, 700)]
    assert [r.n_removed for r in lines.report(documents(pair)).orderBy("doc_id").collect()] == [0, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "dd", "e", ""]), max_size=12), st.lists(st.sampled_from(["a", "bb", "ccc", "dd", "e", ""]), max_size=12))
def test_one_way_is_a_bound(v, w):
    assert lines._one_way(v, w, 1e9) >= lines.edit_distance(" ".join(v), " ".join(w))
    assert lines._one_way(v, v, 0) == 0 and (lines._one_way(v, w, 3) <= 3) == (lines._one_way(v, w, 1e9) <= 3)


def test_counts_of_letters_rule_out_only_what_is_far():
    draw = np.random.default_rng(9)
    for _ in range(60):
        a = prose(int(draw.integers(1000)), 40)
        b = list(a)
        for _ in range(int(draw.integers(1, 60))):
            k = int(draw.integers(len(b)))
            b[k : k + int(draw.integers(2))] = ["q"] * int(draw.integers(2))
        b = "".join(b)
        assert not lines._apart(a, b, lines.edit_distance(a, b))
    assert lines._apart(prose(1, 60), prose(2, 60), 20)
