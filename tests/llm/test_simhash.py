import random

import numpy as np
import pytest
import xxhash

from maskwright.llm import common
from maskwright.llm import simhash as S
from maskwright.llm.common import components, staged


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(ids, fps, bits=2):
    roots = list(range(len(ids)))

    def find(x):
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= bits:
                roots[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_fingerprints(odd):
    for t in [*odd, "a b", "One two\tthree  four\x0bfive", "Ünï cödé straße ẞ", "a b c d e"]:
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_long_texts_are_hashed_in_slabs(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "SLAB", 64)
    assert S.fingerprint(text) == want == plain_fingerprint(text)


@pytest.mark.parametrize("group", [48, 3])
def test_components_against_brute_force(spark, monkeypatch, group):
    """Both ways of linking, that of ordinary and that of large groups, give the same components."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = random.Random(group)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            fps.append(f)
            if rng.random() < 0.7:
                for b in rng.sample(range(64), rng.randint(0, 3)):
                    f ^= 1 << b
    fps += [0, 0, 3, (1 << 64) - 1]
    ids = rng.sample(range(10_000), len(fps))
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in df.join(S.near_duplicates(df), "fp").collect()}
    assert got == brute(ids, fps)


def test_thresholds_hold_every_pair():
    rng = np.random.default_rng(0)
    bits = (rng.random((4000, 64)) < rng.random(64)).astype(float)
    bits[:, 32:40] = bits[:, :8]  # correlated bits
    both = bits.T @ bits
    for parts in range(2, 5):
        groups = S.correlated_partitions(4000, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
    groups = S.correlated_partitions(4000, both, 4)
    assert any(set(g) >= {b, b + 32} for g in groups for b in range(8))
    chosen = S.plan(10**6, both)
    assert all(t >= 0 for _, t in chosen)
    for _ in range(300):
        pair = set(rng.choice(64, 2, replace=False).tolist())
        assert any(len(pair & set(g)) <= t for g, t in chosen)


def test_allocation_is_the_least():
    costs = [[0, 5, 9, 20], [0, 1, 2, 3], [0, 7, 8, 9]]
    assert S.allocate(costs, 0) == (0 + 3 + 0, [-1, 2, -1])


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 200), (None, 3), (300, 301)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 300: 300, 301: 300}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4])
@pytest.mark.parametrize("crowd", [None, 2])
def test_other_thresholds_against_brute_force(spark, monkeypatch, max_bits, crowd):
    """Any threshold, in small groups and by midpoints."""
    if crowd:
        monkeypatch.setattr(S, "crowd", lambda max_bits: crowd)
    rng = random.Random(max_bits)
    fps, f = [], 0
    for _ in range(40):
        f ^= sum(1 << b for b in rng.sample(range(40), rng.choice([0, 1, max_bits, max_bits + 1, 12])))
        fps.append(f)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in df.join(S.near_duplicates(df, max_bits), "fp").collect()}
    assert got == brute(list(range(len(fps))), fps, max_bits)


def test_components_of_a_star_over_many_partitions(spark, monkeypatch):
    """A hub of 100,000 edges, and nothing that may be broadcast but the rows of hot keys."""
    n = 100_000
    star = spark.range(1, n + 1, numPartitions=8).selectExpr("id as a", "0L as b").unionByName(spark.createDataFrame([(n + 5, n + 6)], "a bigint, b bigint"))
    monkeypatch.setattr(common, "BROADCAST_LIMIT", 0)
    roots = components(star)
    assert roots.count() == n + 3 and roots.where(f"root <> 0 and node <= {n}").isEmpty() and roots.where(f"node > {n} and root <> {n + 5}").isEmpty()


@pytest.mark.parametrize("hot_limit", [8 << 20, 0])
def test_keyed_join_on_every_path(spark, monkeypatch, hot_limit):
    left = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 95, 96, 500)], "k int, w string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, common.keyed_join(left, right, "k", how).collect()), key=str) == want
        monkeypatch.setattr(common, "BROADCAST_LIMIT", 0)
        monkeypatch.setattr(common, "HOT_LIMIT", hot_limit)
        for rows in (10, 10_000):
            monkeypatch.setattr(common, "HOT_ROWS", rows)
            assert sorted(map(tuple, common.keyed_join(left, right, "k", how).collect()), key=str) == want
        monkeypatch.undo()


def test_stage_keeps_one_of_each_group(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(300))
    docs = make_docs([(5, text), (3, text), (9, text + " more"), (4, "something else altogether here"), (None, text), (3, text)])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"] or -1) for r in kept.collect())
    near = (S.fingerprint(text) ^ S.fingerprint(text + " more")).bit_count() <= 2
    assert rows == [-1, 3, 4, *([] if near else [9])]
    assert S.keep_one(docs.limit(0)).count() == 0


def test_query(spark, make_docs, folder, odd):
    sf = folder(documents=make_docs(odd))
    got = {r["doc_id"]: r for r in S.op8_simhash(spark, sf).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(odd)}
    assert {i: r["component_id"] for i, r in got.items()} == brute(list(range(len(odd))), [plain_fingerprint(t) for t in odd])
    assert staged(spark.range(3), "x").count() == 3
