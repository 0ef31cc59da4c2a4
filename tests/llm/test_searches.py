"""Nearest neighbours, license scans, repeated strings, the registered queries and the pipeline."""

import hashlib
import math

import numpy as np
import pytest
from helpers import clashing, odd_rows, prose

import corpus_pipeline
from canvasser.llm import licences, neighbours, queries, repeats
from canvasser.llm.common import saved

VECTORS = "vec_id long, embedding array<float>, label int"


def exact(rows, k, every):
    own = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in own:
        if q % every == 0:
            near = sorted((-float(own[q] @ own[c]), c) for c in own if c != q)[:k]
            out[q] = [(c, -s) for s, c in near]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(c, s) for _, c, s in sorted(v)] for q, v in out.items()}


def test_recall(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 48)) + 0.5 * draw.normal(size=(6, 48))[draw.integers(0, 6, 3000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = found(neighbours.search(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)))
    want = exact(rows, 20, 20)
    assert got.keys() == want.keys()
    recall = np.mean([len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.93
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and len(hits) == 20
        assert all(abs(s - float(np.float64(x[q]) @ np.float64(x[c]))) < 1e-12 for c, s in hits)


@pytest.mark.parametrize("cell", [neighbours.CELL, 3])
def test_copies_ties_and_odd_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0, 0.0, -1.0]) for k in range(60)] + [(100 + k, [math.cos(k), math.sin(k), 0.5, k / 10]) for k in range(30)]
    odd = [(None, [1.0, 0.0, 0.0, 0.0]), (200, None), (220, [0.0] * 4), (240, [1.0, nan, 0.0, 0.0]), (260, [inf, 0.0, 0.0, 0.0]), (280, [1.0, None, 0.0, 0.0]), (300, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in [*rows, *odd, rows[20]]], VECTORS)
    got = found(neighbours.search(clashing(frame)))
    want = exact(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert [c for c, _ in got[40]] == [c for c, _ in want[40]]  # ties go to the smaller id
    few = found(neighbours.search(spark.createDataFrame([(*r, 1) for r in rows[58:64]], VECTORS), every=59))
    assert [len(v) for v in few.values()] == [5]
    assert neighbours.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def templates(spark):
    return spark.createDataFrame([*licences.TEMPLATES, ("none", None), (None, "a b c"), ("short", "one two")], "license string, text string")


@pytest.mark.parametrize("slice_rows", [licences.SLICE_ROWS, 40])
def test_licenses(spark, documents, none, slice_rows):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    changed = mit.replace("free of charge", "at no charge").replace("any person", "any other person").upper()
    texts = [
        prose(1, 50) + "\n" + mit + "\n" + prose(2, 50), prose(3, 30) + " " + changed, "Released under the MIT License.", "released under a MIT licence",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. " + prose(4, 400) + " licensed under cc-by nc 4.0", prose(5, 200), "", None,
        " ".join(mit.split()[:12]) + " " + prose(6, 40),
    ]
    rows = licences.scan(clashing(documents(texts)), templates(spark), into="hits2", slice_rows=slice_rows).collect()
    got = {r.doc_id: [(m.license, round(m.coverage, 2), r.text[m.start : m.end]) for m in r.hits2] for r in rows}
    assert got[0] == [("MIT", 1.0, mit)] and got[2] == [("MIT", 1.0, "Released under the MIT License")]
    assert [(m[0], m[2]) for m in got[1]] == [("MIT", changed)] and 0.8 <= got[1][0][1] < 1
    assert [m[:2] for m in got[4]] == [("CC-BY-NC-4.0", 1.0)] * 3
    assert got[3] == got[5] == got[6] == got[7] == got[8] == []
    best = {(r.doc_id, r.license): r.n_matches for r in licences.report(documents(texts), templates(spark)).collect()}
    assert best == {(0, "MIT"): 1, (1, "MIT"): 1, (2, "MIT"): 1, (4, "CC-BY-NC-4.0"): 3}
    assert licences.report(none, templates(spark)).count() == 0
    assert licences.report(clashing(documents(odd_rows())), templates(spark)).count() == 0
    assert licences.report(documents(texts), templates(spark).limit(0)).count() == 0


def brute_repeats(docs, length):
    """docs in order; equal (id, text) are one document."""
    seen, out, done = set(), [], {}
    for doc, text in docs:
        raw = (text or "").encode()
        if (doc, text) not in done:
            gone = bytearray(len(raw))
            for s in range(len(raw) - length + 1):
                part = raw[s : s + length]
                if part in seen:
                    gone[s : s + length] = b"\1" * length
                seen.add(part)
            done[(doc, text)] = gone
        gone = done[(doc, text)]
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, hot", [(100, repeats.HOT), (100, 2), (7, repeats.HOT), (7, 1), (1, 50)])
def test_repeats(documents, length, hot):
    passage = prose(70, 30)
    n = 40 if length > 50 else 12
    texts = [prose(k, n) + passage[k:] + prose(200 + k, n) + passage[: 60 + k] for k in range(12)]
    texts += [texts[3], texts[3] + "é", "ab" * 150, "x" * 99, "x" * 100, "x" * 101, "", None, prose(3, 40) * 3]
    got = repeats.report(clashing(documents(texts)), length=length, hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(list(enumerate(texts)), length)


def test_repeats_over_many_batches(spark, documents):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        passage = prose(71, 40)
        texts = [prose(k, 15) + passage + prose(300 + k, 15) for k in range(60)] + [prose(k, 60) for k in range(20)] * 2
        got = repeats.report(documents(texts).repartition(7), hot=5)
        assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(list(enumerate(texts)), 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_in_cut_documents(documents, monkeypatch):
    text = prose(1, 900)
    bodies = [text.encode(), b"z" * 50 + text.encode()[400:3000]]
    whole = repeats.runs(bodies, 100)
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = repeats.runs(bodies, 100)
    assert cut["n"].sum() == whole["n"].sum() == sum(len(b) - 99 for b in bodies)


def test_repeats_odd_rows(documents, none):
    rows = [r for r in odd_rows() if r[0] != 10]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = repeats.report(clashing(documents(rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats([(r[0], r[1]) for r in order], 100)
    two = documents([r for r in odd_rows() if r[0] == 10])
    assert [r.n_removed for r in repeats.report(two).collect()] == [0, 0]
    assert repeats.report(none).count() == 0


def test_stages_keep_the_columns_and_odd_rows(spark, documents, none, tmp_path):
    spark.createDataFrame([(1, prose(1, 80))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (documents(odd_rows()), none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            after = saved(stage(spark, docs, str(tmp_path)), "test-stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == start.columns and after.schema == docs.schema, name
                docs = after
        assert after.count() == docs.count() and after.filter("NOT exact").count() == 0


def test_pipeline_against_single_steps(spark, documents, tmp_path):
    """The same decisions from the operators' reports, applied row by row in plain Python."""
    from canvasser.llm import decontaminate, jaccard, lines, toxicity

    texts = []
    for k in range(300):
        text = "\n".join([prose(k, 40), prose(k % 9, 12), prose(1000 + k, 30)])
        texts.append(text.replace(" ", f" vile{k % 5} ", 3) if k % 6 == 0 else text)
    texts += [prose(k, 40).replace(" ", "\n", 5) + "\n" + prose(1000 + k, 30) for k in range(400, 420)]
    texts += [prose(k, 40) + " " + prose(1000 + k, 30) for k in range(400, 420)] + [prose(900, 25) + " " + prose(2000 + k, 20) for k in range(5)]
    docs = documents(texts)
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(900, 25))], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {r.doc_id for r in toxicity.report(docs, labels).collect() if not r.predicted}
    left = [(k, t) for k, t in enumerate(texts) if k in good]
    frame = spark.createDataFrame(left, "doc_id long, text string")
    cut = {r.doc_id: r.gone for r in lines.dedup_lines(frame, mark="gone").collect()}
    left = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[k])) for k, t in left]
    frame = spark.createDataFrame(left, "doc_id long, text string")
    group = {r.doc_id: (r.class_id, r.n_shingles) for r in jaccard.report(frame).collect()}
    left = [(k, t) for k, t in left if group[k][0] == k or not group[k][1]]
    frame = spark.createDataFrame(left, "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.report(frame, bench).collect() if r.contaminated}
    want = {k: t for k, t in left if k not in bad}
    assert bad and len(left) < len(good) < len(texts)

    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in want.items()}


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
