import random

import numpy as np

from maskwright.llm import paragraphs as P
from maskwright.llm import simhash as S
from maskwright.llm.common import live_paths, staged
from tests.llm.test_paragraphs import edited, paragraph


def brute(texts):
    """The least id of each component of equal texts and of those with a Jaccard similarity of 0.8, all pairs compared."""
    roots = list(range(len(texts)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    words = [(t or "").encode().lower().split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or P.jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = sorted((find(i), find(j)))
                roots[b] = a
    return {find(i) for i in range(len(texts))}


def test_stage_against_brute_force_jaccard(spark, make_docs, odd):
    """Near copies of 0.8 and more go though their fingerprints differ by many bits, a large group of them too; less similar texts stay."""
    rng = random.Random(8)
    families = [paragraph(rng, n) for n in (8, 30, 120, 300)]
    texts = [*odd, "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    for ws in families:
        texts += [" ".join(edited(rng, ws, round(share * len(ws) / 5))) for share in (0, 0.05, 0.1, 0.12, 0.2, 0.4)]
    texts += [" ".join(edited(rng, families[2], rng.randint(0, 3))) for _ in range(P.PAIRED + 20)]
    want = brute(texts)
    pairs = [(a, b) for a in texts for b in texts if a and b and a < b and P.jaccard(a, b) >= 0.8]
    assert max((S.fingerprint(a) ^ S.fingerprint(b)).bit_count() for a, b in pairs) > 2 and len(want) < len(texts) - P.PAIRED
    assert {r["doc_id"] for r in S.keep_one(make_docs(texts)).collect()} == want


def test_bands_miss_few():
    assert (1 - P.SIMILARITY**S.ROWS) ** S.BANDS < S.MISSED


def test_partitions_of_the_fingerprint_miss_few():
    """Candidates come from SimHash: texts of just 0.8 differ in no more bits than the partitions are made for, and the bits are plain majorities."""
    rng = np.random.default_rng(3)
    for documents in (0, 10_000, 3_000_000):
        parts, bits = S.cuts(documents)
        assert (1 - (1 - S.DIFFER) ** bits) ** parts < S.MISSED
    apart = []
    for n in (10, 90, 900):
        for _ in range(40):
            every = rng.integers(0, 2**63, n + n // 10 * 2, dtype=np.uint64)
            a, b = (S.wide_bits(x, 20) for x in (every[: n + n // 10], every[n // 10 * 2 - n // 10 :]))
            apart.append((a != b).mean())
    assert abs(np.mean(apart) - 0.15) < 0.02 and S.MOST > S.HELD * max(S.DIFFER, np.mean(apart))
    few = rng.integers(0, 2**63, 700, dtype=np.uint64)
    factors, addends = S._factors(2)
    want = [sum(int(h) >> k & 1 for h in S._mixed(few * factors[w] + addends[w])) * 2 > len(few) for w in range(2) for k in range(64)]
    assert S.wide_bits(few, 2).tolist() == want


def test_short_texts_meet_at_their_shingles(spark, make_docs):
    """Of eight and nine words, which differ in more bits than others, none is missed."""
    rng = random.Random(6)
    texts = []
    for _ in range(300):
        ws = paragraph(rng, 8)
        texts += [" ".join(ws), " ".join([*ws, "more"])]
    assert {r["doc_id"] for r in S.keep_one(make_docs(texts)).collect()} == set(range(0, 600, 2))


def test_crowded_values_bring_back_only_members_that_may_be_similar(spark, make_docs, monkeypatch):
    """Where a value is compared once more, those that share it by chance and are like none stay out; the outlines spare most pairs their texts, and what the stage staged for itself goes."""
    rng = random.Random(4)
    ws = paragraph(rng, 200)
    texts = [" ".join(edited(rng, ws, rng.randint(1, 8))) for _ in range(160)] + [" ".join(paragraph(rng, 200)) for _ in range(300)]
    seen = {}

    def kept(df, name):
        out = staged(df, name)
        seen.setdefault(name, out.collect())
        return out

    for module in (P, S):
        monkeypatch.setattr(module, "staged", kept)
    before = live_paths(spark)
    assert {r["doc_id"] for r in S.keep_one(make_docs(texts)).collect()} == brute(texts)
    of = {r["id"]: r["doc_id"] for r in seen["classes"]}
    assert seen["crowded"] and {of[r["id"]] for r in seen["crowded"]} <= set(range(160))
    assert 0 < len(seen["sieved"]) < len(seen["pairs"]) and {tuple(r) for r in seen["verified"]} <= {tuple(r) for r in seen["sieved"]}
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in live_paths(spark) if p not in before} <= {"repeated", "stay", "gone"}


def test_texts_that_share_a_passage_are_not_paired_out(spark, make_docs, monkeypatch):
    """Texts half alike pass by their bits but are compared by outlines where they meet, so their pairs are not written; copies among them are found."""
    rng = random.Random(9)
    texts, want = [" ".join(paragraph(rng, 180)) for _ in range(300)], set(range(300))
    for _ in range(12):
        common = paragraph(rng, 120)
        for _ in range(30):
            own = [*common, *paragraph(rng, 60)]
            want.add(len(texts))
            texts.append(" ".join(own))
        texts.append(" ".join(edited(rng, own, 2)))
    assert 0.4 < P.jaccard(texts[300], texts[301]) < 0.6 and P.jaccard(texts[-1], texts[-2]) >= 0.8
    found = []

    def kept(df, name):
        out = staged(df, name)
        if name == "pairs":
            found.append(out.count())
        return out

    monkeypatch.setattr(P, "staged", kept)
    assert {r["doc_id"] for r in S.keep_one(make_docs(texts)).collect()} == want
    assert 12 <= sum(found) < 2 * len(texts)


def test_members_that_touch_none():
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 2**64, (700, 2), dtype=np.uint64)
    marks[9], marks[600] = marks[3] ^ np.uint64(5), marks[8]
    sizes = np.full(700, 50)
    sizes[600] = 5  # too few for its like
    assert np.flatnonzero(P.touching(sizes, marks, 0.8, 20)).tolist() == np.flatnonzero(P.touching(sizes, marks, 0.8, None)).tolist() == [3, 9]
    assert P.touching(sizes[:1], marks[:1], 0.8, None).tolist() == [False]
