"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (beginnings of words), mined
from labelled documents: those that speak for toxic ones, those that speak for
clean ones, and one more that votes clean where none of the former fires.  A
voter fires on a document or abstains.  Over all documents open to training their
joint firings are counted, pair by pair, and a generative label model estimates
each voter's accuracy, how often it fires on toxic and on clean documents, and
which voters are correlated beyond that; a correlated group counts as its share
of independent votes.  Labels serve to find voters and to estimate their
accuracies, no more: the model's posterior, from the votes alone, is the training
label of every document that the linear classifier is fitted on, most of them
without a label of their own.  The classifier, over words and beginnings of
words, scores every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import staged

WORD = re.compile(r"[^\W_]+")
#: Beginnings of words that count as features, in characters.
BEGINNINGS = (3, 4, 5, 6)
#: Labelled documents that the voters are found on, at most, and documents without a label that the classifier is fitted on beside them: those of the least hashes of ids.
SAMPLE, UNLABELLED = 16_000, 16_000
#: Terms that the classifier weighs, at most: those that depend most on the label by chi-squared.  From each of LEAST documents on.
FEATURES, LEAST = 2_000, 3
#: Voters, at most.  Each fires on so many toxic documents of the sample at least, and its share of toxic ones is this high.
VOTERS, SUPPORT, PRECISION = 64, 4, 0.75
#: So many voters are sought for each toxic document of the sample.
COVER = 3
#: Voters for clean documents, at most.  Each fires where so many toxic documents would be by chance, and on a tenth of them at most.
CLEAN_VOTERS, CLEAN_EXPECTED, CLEAN_SHARE = 16, 12, 0.1
#: How many clean documents a toxic one outweighs in the classifier's fit.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.3
HELD_OUT = 2


def words(text: str | None) -> list[str]:
    """Words in lower case; none for null."""
    return WORD.findall((text or "").lower())


def terms(word: str) -> list[str]:
    """The word and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def document_terms(text: str | None) -> set[str]:
    return {t for w in set(words(text)) for t in terms(w)}


def is_held_out(ids):
    """Whether crc32 of the id as text leaves HELD_OUT on division by 4; rows without an id are not held out and have no label."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


# --- voters ----------------------------------------------------------------------


def telling_terms(sample: DataFrame) -> list[str]:
    """The FEATURES terms of ``sample(toxic, terms)`` that depend most on the label, counted where they are."""
    size = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = size["n"], size["t"] or 0
    if not 0 < t < n:
        return []
    counts = sample.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    excess = F.col("t") - F.col("n") * (t / n)
    chi = excess * excess / (F.col("n") * (t / n) * (1 - t / n) * (1 - F.col("n") / (n + 1)))
    return [r["term"] for r in counts.orderBy(F.desc(chi), "term").limit(FEATURES).collect()]


def pick_voters(fired: list[np.ndarray], toxic: np.ndarray, k: int) -> list[int]:
    """Which of ``k`` terms become voters: again and again the one that fires on most toxic documents that fewer than COVER picked ones fire on.  Terms that fire where a picked one does, nine times in ten, are passed over."""
    docs_of: list[list[int]] = [[] for _ in range(k)]
    for d, terms_of in enumerate(fired):
        for i in terms_of:
            docs_of[i].append(d)
    hits = {i: {d for d in docs if toxic[d]} for i, docs in enumerate(docs_of)}
    able = {i for i, docs in enumerate(docs_of) if len(hits[i]) >= SUPPORT and len(hits[i]) >= PRECISION * len(docs)}
    picked: list[int] = []
    times: dict[int, int] = {}
    while able and len(picked) < VOTERS:
        gain = {i: sum(times.get(d, 0) < COVER for d in hits[i]) * len(hits[i]) / len(docs_of[i]) for i in able}
        best = max(sorted(able), key=gain.__getitem__)
        if gain[best] < 1:
            break
        able.discard(best)
        if any(len(hits[best] & hits[i]) > 0.9 * len(hits[best] | hits[i]) for i in picked):
            continue
        picked.append(best)
        for d in hits[best]:
            times[d] = times.get(d, 0) + 1
    return picked


def pick_clean_voters(fired: list[np.ndarray], toxic: np.ndarray, k: int) -> list[int]:
    """Which of ``k`` terms vote clean: those that fire on the most documents of which far fewer are toxic than by chance."""
    n, of_toxic = np.zeros(k), np.zeros(k)
    for d, terms_of in enumerate(fired):
        n[terms_of] += 1
        of_toxic[terms_of] += toxic[d]
    chance = n * (toxic.mean() if len(toxic) else 0.0)
    able = np.flatnonzero((chance >= CLEAN_EXPECTED) & (of_toxic <= CLEAN_SHARE * chance))
    return [int(i) for i in able[np.lexsort((able, of_toxic[able] - chance[able]))][:CLEAN_VOTERS]]


def firings(texts: pd.Series, voters: list[str]) -> np.ndarray:
    """Which voters (columns) fire on which texts (rows)."""
    at = {v: i for i, v in enumerate(voters)}
    known: dict[str, tuple[int, ...]] = {}
    out = np.zeros((len(texts), len(voters)), np.uint8)
    for row, text in enumerate(texts):
        hit: set[int] = set()
        for w in set(words(text)):
            if (ids := known.get(w)) is None:
                ids = tuple(at[t] for t in terms(w) if t in at)
                if len(known) < 100_000:
                    known[w] = ids
            hit.update(ids)
        out[row, list(hit)] = 1
    return out


def joint_counts(docs: DataFrame, voters: list[str], n_toxic: int) -> tuple[int, int, np.ndarray]:
    """Over all of ``docs(text)``: how many there are, on how many none of the first ``n_toxic`` voters fires, and how often each two voters fire together."""
    k = len(voters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, silent = np.zeros((k, k)), 0, 0
        for pdf in batches:
            x = firings(pdf["text"], voters).astype(np.float32)
            total, n, silent = total + x.T @ x, n + len(x), silent + int((x[:, :n_toxic].sum(axis=1) == 0).sum())
        yield pd.DataFrame({"cell": np.arange(k * k + 2), "n": np.append(total.ravel(), [silent, n]).astype(np.int64)})

    cells = docs.select("text").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(k * k + 2)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), int(flat[-2]), flat[:-2].reshape(k, k)


# --- label model -------------------------------------------------------------------


@dataclass
class LabelModel:
    """Firing rates of the voters on toxic and clean documents, the share of toxic ones, the weight of each voter's vote within its correlated group, and the logarithm of odds that silence of all toxic voters, the first ``n_toxic``, gives."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray
    n_toxic: int
    silence: float = 0.0

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Of documents by the votes of those that fire, and by silence; without toxic voters the prior is left."""
        silent = fired[:, : self.n_toxic].sum(axis=1) == 0
        margin = math.log(self.prior / (1 - self.prior)) + fired @ (np.log(self.on_toxic / self.on_clean) * self.weight) + silent * self.silence
        return 1 / (1 + np.exp(-np.clip(margin, -20, 20)))


def blocks_of(joint: np.ndarray, expected: np.ndarray) -> list[list[int]]:
    """Voters in blocks that fire together at least a quarter as often as independent ones would, as those of one language do; voters of different blocks exclude each other."""
    k, left, out = len(joint), set(range(len(joint))), []
    linked = joint >= 0.25 * expected
    while left:
        block, todo = [], [min(left)]
        left.discard(todo[0])
        while todo:
            i = todo.pop()
            block.append(i)
            near = [j for j in range(k) if j in left and linked[i, j]]
            left.difference_update(near)
            todo += near
        out.append(sorted(block))
    return out


def fit_label_model(n: int, both: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 200, n_toxic: int | None = None, silent: int | None = None) -> LabelModel:
    """Fit firing rates to the joint firings ``both`` of ``n`` documents, from those on the labelled sample (firings on ``toxic`` and on ``clean`` documents).

    The first ``n_toxic`` voters speak for toxic documents, on ``silent`` of all
    documents none of those fires; the others speak for clean ones, and their
    rates are the sample's on toxic documents and, by the rate over all, what is
    left for clean ones.

    A voter knows the toxic documents of its block alone.  Given those, voters
    of a block are taken as independent but for pairs whose joint firings exceed
    what their rates give by far; those pairs are correlated and take no part in
    the fit.  A voter's weight is one over the number of voters it is correlated
    with, itself included, each counted by the strength.
    """
    k = len(both)
    prior = min(max(len(toxic) / max(len(toxic) + len(clean), 1), 1e-3), 0.5)
    smooth = lambda part: (part.sum(axis=0) + 0.05) / (len(part) + 1)
    rate, joint = np.diag(both) / max(n, 1), both / max(n, 1)
    on_toxic, on_clean, strength = np.clip(smooth(toxic), 1e-3, 0.999), np.clip(smooth(clean), 1e-6, 0.5), np.zeros((k, k))
    n_toxic = k if n_toxic is None else n_toxic
    for block in blocks_of(joint[:n_toxic, :n_toxic], prior * np.outer(on_toxic[:n_toxic], on_toxic[:n_toxic])):
        share = prior * (toxic[:, block].any(axis=1).sum() + 0.5) / (len(toxic) + 1)  # of documents the block's toxic ones
        a, b = np.clip(on_toxic[block] * prior / share, 1e-3, 0.999), on_clean[block]
        own_rate, own = rate[block], joint[np.ix_(block, block)]
        off = ~np.eye(len(block), dtype=bool)
        spread = np.sqrt(np.outer(own_rate * (1 - own_rate), own_rate * (1 - own_rate))) + 1e-12
        excess = np.clip((own - share * np.outer(a, a) - (1 - share) * np.outer(b, b)) / spread, 0, 1) * off
        excess[excess < 0.25] = 0
        free = off & (excess == 0)
        for _ in range(rounds if free.any() else 0):
            # one step of least squares on the independent pairs, the single rates held by the clean side
            residual = np.where(free, own - share * np.outer(a, a) - (1 - share) * np.outer(b, b), 0.0)
            a = np.clip(a + 0.5 * (residual @ a) / (share * np.where(free, a[None, :] ** 2, 0).sum(axis=1) + 1e-9), 1e-3, 0.999)
            b = np.clip((own_rate - share * a) / (1 - share), 1e-6, 0.5)
        on_toxic[block], on_clean[block] = a * share / prior, b
        strength[np.ix_(block, block)] = excess
    late = np.arange(n_toxic, k)
    on_clean[late] = np.clip((rate[late] - prior * on_toxic[late]) / (1 - prior), 1e-6, 0.999)
    spread = np.sqrt(rate[late] * (1 - rate[late])) + 1e-12
    together = np.clip((joint[np.ix_(late, late)] - np.outer(rate[late], rate[late])) / np.outer(spread, spread), 0, 1) * ~np.eye(len(late), dtype=bool)
    strength[np.ix_(late, late)] = np.where(together < 0.1, 0, together)
    quiet = 0.0
    if silent is not None and n_toxic and len(toxic):
        on = ((toxic[:, :n_toxic].sum(axis=1) == 0).sum() + 0.5) / (len(toxic) + 1)
        off = min(max((silent / max(n, 1) - prior * on) / (1 - prior), 1e-3), 0.999)
        quiet = min(0.0, math.log(on / off))
    return LabelModel(prior, np.maximum(on_toxic, 1e-4), np.maximum(on_clean, 1.0 / max(n, 1)), 1 / (1 + strength.sum(axis=1)), n_toxic, quiet)


# --- classifier --------------------------------------------------------------------


@dataclass
class Classifier:
    """Weights by term, the others being zero."""

    bias: float
    weights: dict[str, float]

    def scores(self, texts) -> np.ndarray:
        """Probabilities; the features are the distinct terms of the whole text."""
        known: dict[str, tuple[str, ...]] = {}
        weights, out = self.weights, np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in set(words(text)):
                if (ts := known.get(w)) is None:
                    ts = tuple(t for t in terms(w) if t in weights)
                    if len(known) < 100_000:
                        known[w] = ts
                if ts:
                    found.update(ts)
            total = self.bias + sum(weights[t] for t in sorted(found))
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
        return out


def fit_classifier(features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, names: list[str], rounds: int = 300, l2: float = 0.1) -> Classifier:
    """Logistic regression on presence features with soft labels and weighted rows, by adaptive gradient steps over all rows."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    place = np.concatenate([np.empty(0, np.int64), *features])
    share = min(max(float(np.average(target, weights=weight)), 1e-3), 0.999)
    w, bias, square, square_b = np.zeros(len(names)), math.log(share / (1 - share)), np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        margin = bias + np.bincount(rows, w[place], len(features))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        grad = np.bincount(place, error[rows], len(names)) + l2 * w
        square += grad**2
        square_b += error.sum() ** 2
        w -= 0.5 / np.sqrt(square) * grad
        bias -= 0.5 * error.sum() / math.sqrt(square_b)
    return Classifier(bias, {name: float(x) for name, x in zip(names, w, strict=True) if abs(x) > 1e-3})


#: What scores texts where there is nothing to learn from.
UNLEARNT = Classifier(-4.0, {})


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit voters, label model and classifier on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, held-out rows aside.

    A document labelled twice counts as toxic if it is so once.  Where no term is
    telling enough to vote, the labels themselves are the training labels; without
    a toxic and a clean example every text scores low.
    """
    open_labels = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = staged(open_labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "sample_ids")
    open_docs = docs.select("doc_id", "text").where("doc_id is not null").where(~is_held_out(F.col("doc_id")))
    # candidates without a label: as many more as may turn out to have one
    others = open_docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE + UNLABELLED)
    others = others.join(open_labels, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    ids = staged(chosen.unionByName(others.withColumn("toxic", F.lit(None).cast("int"))), "training_ids")

    @F.pandas_udf("array<string>")
    def all_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(document_terms(t)) for t in texts])

    rows = open_docs.join(F.broadcast(ids), "doc_id")  # SAMPLE + UNLABELLED ids at most
    sample = staged(rows.where("toxic is not null").select("doc_id", "toxic", all_terms("text").alias("terms")), "sample")
    names = telling_terms(sample)
    if not names:
        return UNLEARNT
    at = {t: i for i, t in enumerate(names)}

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(at[t] for t in document_terms(text) if t in at) for text in texts])

    found = staged(rows.select("doc_id", "toxic", places("text").alias("f")), "features").orderBy("doc_id", "f").collect()  # a few numbers for each of SAMPLE + UNLABELLED documents at most
    features = [np.array(r["f"], np.int64) for r in found]
    own = np.array([np.nan if r["toxic"] is None else r["toxic"] for r in found], float)
    known = ~np.isnan(own)
    labelled, y = [f for f, k in zip(features, known, strict=True) if k], own[known]
    voters = pick_voters(labelled, y > 0, len(names))
    if not voters:
        return fit_classifier(labelled, y, np.where(y == 1, TOXIC_WEIGHT, 1.0), names)
    n_toxic = len(voters)
    voters += [v for v in pick_clean_voters(labelled, y, len(names)) if v not in voters]
    n, silent, both = joint_counts(docs.where(~is_held_out(F.col("doc_id"))), [names[v] for v in voters], n_toxic)
    fired = np.stack([np.isin(voters, f) for f in features]).astype(float)
    model = fit_label_model(n, both, fired[known][y == 1], fired[known][y == 0], n_toxic=n_toxic, silent=silent)
    target = model.posterior(fired)
    return fit_classifier(features, target, 1 + (TOXIC_WEIGHT - 1) * target, names)


def scored(docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores; empty and null texts have the score of no words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return docs.withColumn(column, score("text"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score and prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that score THRESHOLD or more go; the rest stays, columns as they are, whatever their names."""
    model = learn(docs.select("doc_id", "text"), labels)
    own = "score" + "_" * max(map(len, docs.columns))  # longer than any name there is
    return scored(docs, model, own).where(F.col(own) < THRESHOLD).drop(own)
