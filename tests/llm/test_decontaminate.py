import hashlib

from helpers import clashing, odd_rows, plain_words, prose

from canvasser.llm import decontaminate

ITEMS = "item_id long, text string"


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if held := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= held
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    bench = [(1, prose(20, 30)), (2, prose(21, 13)), (12, prose(21, 13)), (3, "Tiny Item here"), (4, ""), (5, None), (None, prose(22, 20)), (6, "one"), (6, prose(23, 15))]
    docs = [
        prose(20, 30), prose(30, 40) + ". " + prose(20, 30).upper() + "! " + prose(31, 40), prose(32, 900) + " tiny, ITEM; here " + prose(33, 5),
        prose(22, 20), "one " + prose(34, 10), prose(23, 14), prose(20, 12), prose(21, 13) + "\n" + prose(21, 13), None, "",
    ]
    return docs, bench


def test_against_brute_force(spark, documents):
    docs, bench = cases()
    items = spark.createDataFrame(bench, ITEMS)
    got = decontaminate.report(documents(docs), items)
    want = brute(list(enumerate(docs)), bench)
    assert sorted(map(tuple, got.collect()), key=str) == want
    many = decontaminate.report(documents(docs), items, slice_rows=7)  # several slices, the same result
    assert sorted(map(tuple, many.collect()), key=str) == want


def test_odd_rows_and_empty_tables(spark, documents, none):
    items = spark.createDataFrame([(1, prose(1, 80)), (2, "x" * 200_000)], ITEMS)
    docs = documents(odd_rows())
    got = {(r.doc_id, r.n_words): r.contaminated for r in decontaminate.report(clashing(docs), items).collect()}
    assert got[(6, 80)] and got[(7, 80)] and got[(9, 1)] and not got[(2, 0)] and not got[(None, 0)]
    assert decontaminate.report(none, items).count() == 0
    clean = decontaminate.report(docs, spark.createDataFrame([], ITEMS))
    assert clean.filter("contaminated OR n_hit > 0").count() == 0 and clean.count() == docs.count()


def test_removal(spark, documents):
    docs, bench = cases()
    items = spark.createDataFrame(bench, ITEMS)
    frame = clashing(documents(docs))
    kept = decontaminate.decontaminate(frame, items)
    bad = {r[0] for r in brute(list(enumerate(docs)), bench) if r[-1]}
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - bad
    assert kept.columns == frame.columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, items, remove="spans").collect()}
    assert cut[1] == prose(30, 40) + ". ! " + prose(31, 40)
    assert cut[0] == "" and cut[8] is None
