import numpy as np
import pytest
from helpers import clashing, odd_rows, prose

from canvasser.llm import quality, samples, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, documents):
    """Toxic texts hold one of a few rare words; texts of low quality are symbols or one word again and again."""
    texts, labels = [], []
    for k in range(600):
        text, toxic, good = prose(k, 60), k % 5 == 0, k % 4 != 1
        if toxic:
            text = text.replace(" ", f" vile{k % 7} ", 2)
        if not good:
            text = " ".join(w + "&&&" for w in text.split()) if k % 8 == 1 else " ".join([prose(k, 1)] * 60)
        texts.append(text)
        labels.append((k, int(good), int(toxic)))
    return documents(texts), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module, label, least", [(toxicity, 2, 0.9), (quality, 1, 0.95)])
def test_held_out_accuracy(corpus, module, label, least):
    docs, labels = corpus
    truth = {r[0]: r[label] for r in labels.collect()}
    rows = module.report(docs, labels).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_empty_tables(spark, documents, none, corpus, module):
    odd = spark.createDataFrame([(None, 1, 1), (6, None, None), (7, 1, 0), (7, 0, 1), (8, 1, 0), (8, 1, 0), (99, 0, 1)], LABELS)
    docs = documents(odd_rows())
    for labels in (odd, spark.createDataFrame([], LABELS)):
        rows = module.report(clashing(docs), labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.report(none, corpus[1]).count() == 0
    rows = module.report(documents(odd_rows()).unionByName(corpus[0].filter("doc_id > 20")), corpus[1]).collect()
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark, corpus):
    docs, labels = corpus
    chosen = samples.labelled(docs, labels, "toxic", 10_000)
    assert chosen.filter(samples.fold() == 0).count() == 0
    assert samples.labelled(docs, labels, "toxic", 50).count() == 50
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(samples.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.report(docs, flipped).collect()}
    assert a == b


def test_passages():
    words = toxicity._words(["a b c", "", "bad a"])[0]
    known = np.sort(words[[4 - 1]])
    model = (known, np.array([3.0]), -0.1)
    x = toxicity.features(["a b c", "", "bad a"], model)
    assert x[0] == pytest.approx([-0.1] * 5) and x[1] == pytest.approx([0] * 5)
    assert x[2] == pytest.approx([1.45, 3.0, 1.45, 1.45, 1.45])


def test_temperature_and_network():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, quality.WIDTH))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    weights = quality.train(x, y, epochs=150)
    assert np.mean((quality.logits(x, weights) > 0) == (y > 0)) > 0.9
    assert quality.temperature(np.array([8.0, -8, 8, -8]), np.array([1.0, 0, 0, 1])) == 8


def test_new_forms_of_known_words_rank_above_ordinary_texts(spark, documents):
    """Every new word occurs in one text only, some in capitals outside ASCII; its beginning tells."""
    texts, labels = [], []
    for k in range(400):
        text, toxic = prose(k, 60), k % 5 == 0
        new = "éclat" if toxic else ("lampe", "écran", "table", "nuage")[k % 4]
        text = " ".join([w for n, w in enumerate(text.split()) for w in ([w, f"{new}{k}x{n}"] if n % 6 == 0 else [w])])
        texts.append(text.upper() if k % 10 == 5 else text)
        labels.append((k, 1, int(toxic)))
    rows = toxicity.report(documents(texts), spark.createDataFrame(labels, LABELS)).filter("held_out").collect()
    bad, good = [r.score for r in rows if r.doc_id % 5 == 0], [r.score for r in rows if r.doc_id % 5]
    assert len(bad) >= 5 and np.mean([[b > g for g in good] for b in bad]) >= 0.95


def test_beginnings():
    from canvasser.llm.hashing import beginnings, join_texts, words

    data, _ = join_texts(["réeuxon RÉEUX réeu rée"])  # the table folds ASCII only
    starts, ends, hashes = words(data)
    a, b, c, d = beginnings(data, starts, ends, 4).tolist()
    assert a == c and len({a, b, d, *hashes.tolist()}) == 7
