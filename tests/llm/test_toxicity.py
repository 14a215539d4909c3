import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import toxicity as X

VOCAB = [f"wort{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        ws = rng.choices(VOCAB, k=rng.randint(5, 60))
        if toxic:
            ws += rng.sample(["idiot", "scum", "moron", "loser", "clown"], 2)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_held_out_rows(spark):
    ids = [0, 1, 2, 3, 77, -5, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "d bigint").select(X.is_held_out(F.col("d"))).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


@pytest.fixture(scope="module")
def learnt(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    # labels of held-out rows are spoilt: they must not be looked at
    labels = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in rows], "doc_id bigint, toxic int")
    return rows, docs, labels, X.learn(docs, labels)


def test_held_out_accuracy(learnt):
    rows, _, _, model = learnt
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    scores = model.scores([t for _, t, _ in held])
    right = [(s >= X.THRESHOLD) == bool(t) for s, (_, _, t) in zip(scores, held, strict=True)]
    assert np.mean(right) > 0.95


def test_odd_texts_and_stage(spark, learnt, make_docs, odd):
    _, docs, labels, model = learnt
    assert all(0 <= s <= 1 for s in model.scores(odd)) and model.scores([None])[0] == model.scores([""])[0] < X.THRESHOLD
    mixed = make_docs(odd + ["idiot scum moron"])
    kept = X.drop_toxic(mixed.unionByName(docs.select("doc_id", "text", F.lit("e").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))), labels)
    texts = [r["text"] for r in kept.where("lang = 'en'").collect()]
    assert kept.columns == mixed.columns and len(texts) == len(odd) and "idiot scum moron" not in texts


def test_nothing_to_learn_from(spark, learnt):
    _, docs, labels, _ = learnt
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert X.learn(docs, none) is X.UNLEARNT
    assert X.learn(docs.limit(0), labels) is X.UNLEARNT


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    n, prior = 40_000, 0.2
    y = rng.random(n) < prior
    a, b = np.array([0.6, 0.4, 0.5, 0.3]), np.array([0.01, 0.02, 0.01, 0.005])
    fired = np.where(y[:, None], rng.random((n, 4)) < a, rng.random((n, 4)) < b).astype(float)
    fired = np.hstack([fired, fired[:, :1]])  # a voter that copies another
    lone = y & (fired.sum(axis=1) == 0) & (rng.random(n) < 0.5)  # a voter of another language
    fired = np.hstack([fired, lone[:, None].astype(float)])
    seen = rng.random(n) < 0.1
    model = X.fit_label_model(n, fired.T @ fired, fired[seen & y], fired[seen & ~y])
    assert np.allclose(model.on_toxic[1:4], a[1:4], atol=0.12) and model.on_toxic[5] > 0.03
    assert model.weight[0] < 0.75 and model.weight[4] < 0.75 and model.weight[1] > 0.9
    posterior = model.posterior(fired)
    assert ((posterior > 0.5) == y).mean() > 0.92


def test_few_labels_and_the_votes(spark):
    """With most labels gone the label model's posteriors of documents without one keep the classifier's ranking, which the labels alone do not."""
    rng = random.Random(8)
    slurs = ["idiot", "scum", "moron", "loser", "clown", "pest", "vermin", "filth", "creep", "oaf"]
    rows = []
    for i in range(4000):
        toxic = rng.random() < 0.15
        ws = rng.choices(VOCAB, k=rng.randint(5, 40)) + (rng.sample(slurs, 3) if toxic else rng.sample(slurs, 1) if rng.random() < 0.01 else [])
        rows.append((i, " ".join(ws), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 400], "doc_id bigint, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] >= 400]
    y = np.array([t for *_, t in held])
    scores = X.learn(docs, labels).scores([t for _, t, _ in held])
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    right = (scores >= X.THRESHOLD) == y
    assert auc > 0.97 and right.mean() > 0.95


def test_labels_alone_where_no_term_votes(spark, monkeypatch):
    monkeypatch.setattr(X, "SUPPORT", 10**6)
    rows = corpus(300)
    model = X.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))
    assert model is not X.UNLEARNT and model.scores(["idiot scum moron"])[0] > model.scores(["worta kein"])[0]


def test_clean_voters_and_silence():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    fired = [np.flatnonzero([rng.random() < (0.6 if t else 0.01), rng.random() < (0.01 if t else 0.5), rng.random() < 0.5]) for t in y]
    assert X.pick_clean_voters(fired, y.astype(float), 3) == [1]
    x = np.stack([np.isin([0, 1], f) for f in fired]).astype(float)
    model = X.fit_label_model(len(x), x.T @ x, x[y], x[~y], n_toxic=1, silent=int((x[:, 0] == 0).sum()))
    p = model.posterior(np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0]]))
    assert p[0] > 0.9 > 0.2 > p[1] > p[2]


def test_ties_and_repeated_ids(spark):
    """Terms that tell alike come in the order of their names, and a repeated doc_id changes no score of another order of rows."""
    rows = corpus(200) + corpus(200)[:40]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    models = [X.learn(spark.createDataFrame([r[:2] for r in some], "doc_id bigint, text string"), labels) for some in (rows, rows[::-1])]
    assert models[0].weights.keys() == models[1].weights.keys() and np.allclose(models[0].scores([r[1] for r in rows]), models[1].scores([r[1] for r in rows]))


def test_query(spark, folder, learnt):
    _, docs, labels, _ = learnt
    rows = X.op9_toxicity(spark, folder(documents=docs, labels=labels)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
