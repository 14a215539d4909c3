import random
from collections import Counter, defaultdict

import pytest

from maskwright.llm import paragraphs as P


def brute(texts):
    ps = [(d, k, line) for d, t in texts for k, line in enumerate((t or "").split("\n")) if len(line.encode().split()) >= P.MIN_WORDS]
    roots = list(range(len(ps)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(ps)):
        for j in range(i):
            if P.jaccard(ps[i][2], ps[j][2]) >= P.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                roots[b] = a
    groups = defaultdict(list)
    for i, (d, k, _) in enumerate(ps):
        groups[find(i)].append((d, k))
    removed, repeated = defaultdict(set), Counter()
    for members in groups.values():
        if len(members) > 1:
            members.sort()
            repeated.update(d for d, _ in members)
            for d, k in members[1:]:
                removed[d].add(k)
    return dict(removed), dict(repeated)


def paragraph(rng, n=60):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"e{rng.randint(0, 10**9)}"
    return ws


@pytest.mark.parametrize(("paired", "finished"), [(64, 4_000_000), (2, 4_000_000), (2, 20)])
def test_against_brute_force(spark, make_docs, odd, monkeypatch, paired, finished):
    """The pivots of large groups remove the same paragraphs as verifying all pairs."""
    monkeypatch.setattr(P, "PAIRED", paired)
    monkeypatch.setattr(P, "FINISHED", finished)
    rng = random.Random(paired)
    families = [paragraph(rng) for _ in range(5)] + [paragraph(rng, 25)]
    texts = list(odd)
    for _ in range(45):
        lines = [" ".join(edited(rng, rng.choice(families), rng.randint(0, 3))) for _ in range(rng.randint(1, 3))]
        lines.append(" ".join(paragraph(rng)))
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = {r["doc_id"]: r for r in P.repeated(make_docs(texts).select("doc_id", "text")).collect()}
    removed, repeated = brute(list(enumerate(texts)))
    assert {d: set(r["removed"]) for d, r in rows.items() if r["removed"]} == removed
    assert {d: r["n_repeated"] for d, r in rows.items() if r["n_repeated"]} == repeated


def test_passages_inside_paragraphs_are_found(spark, make_docs):
    rng = random.Random(4)
    passage = " ".join(paragraph(rng, P.PASSAGE))
    texts = [f"{' '.join(paragraph(rng, 80))} {passage if k % 2 else ''} {' '.join(paragraph(rng, 90))}" for k in range(10)]
    rows = {r["doc_id"]: r for r in P.repeated(make_docs(texts).select("doc_id", "text")).collect()}
    assert set(rows) == {1, 3, 5, 7, 9} and all(r["n_passages"] and set(r["passage_docs"]) <= set(rows) for r in rows.values())


def test_winnowing_finds_every_shared_run():
    import numpy as np

    rng = np.random.default_rng(2)
    run = rng.integers(0, 2**63, P.PASSAGE, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 80), dtype=np.uint64), run, rng.integers(0, 2**63, rng.integers(0, 80), dtype=np.uint64)]) for _ in range(2))
        assert set(P.winnowed(a)[1].tolist()) & set(P.winnowed(b)[1].tolist())


def test_tuning():
    bands, rows = P.tune()
    assert (1 - P.SIMILARITY**rows) ** bands < P.MISSED


def test_clean_and_empty_and_missing(spark, make_docs):
    rng = random.Random(1)
    clean = make_docs([" ".join(paragraph(rng, 100)) for _ in range(20)])
    assert P.repeated(clean.select("doc_id", "text")).count() == 0
    assert P.repeated(clean.limit(0).select("doc_id", "text")).count() == 0
    same = " ".join(paragraph(rng))
    docs = make_docs([(1, same + "\nshort"), (2, "x\n" + same), (None, same)])
    out = {r["doc_id"]: r["text"] for r in P.without_repeats(docs).collect()}
    assert out == {1: same + "\nshort", 2: "x", None: same}


def test_groups_verify_in_proportion_to_their_members(spark, monkeypatch):
    """A crowd of near copies, and one of paragraphs that share a passage but are not similar, bring few pairs, and lose no link."""
    rng = random.Random(12)
    whole, passage = paragraph(rng, 80), paragraph(rng, 60)
    texts = [" ".join(edited(rng, whole, rng.randint(0, 1))) for _ in range(300)] + [" ".join(paragraph(rng, rng.randint(15, 40)) + passage) for _ in range(300)]
    near = [" ".join(edited(rng, texts[-1].split(), 1)) for _ in range(2)]
    texts = list(dict.fromkeys(texts + near))
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, paragraph string")
    members = rows.selectExpr("id", "explode(array(1L, 2L)) as key").join(P.outlines(rows), "id")
    asked, checked = [], P.verified
    monkeypatch.setattr(P, "verified", lambda pairs, of: checked(asked.append(pairs.count()) or pairs, of))
    roots = list(range(len(texts)))
    for r in P.similar(members, lambda ids: rows.join(ids, "id")).collect():
        old, new = max(roots[r["a"]], roots[r["b"]]), min(roots[r["a"]], roots[r["b"]])
        roots = [new if q == old else q for q in roots]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and P.jaccard(texts[i], texts[j]) >= P.SIMILARITY:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if q == old else q for q in want]
    assert roots == want and len(set(want)) < 310 and sum(asked) < 8 * len(texts)
