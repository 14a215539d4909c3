import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from maskwright.llm import common
from maskwright.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id bigint, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = {}
    windows = [(str(i), tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for i, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_against_brute_force(spark, make_docs, odd):
    rng = random.Random(3)
    vocab = ["the", "of", "Éa", "b2", "ñ", "x", "y", "zed", "İst", "k"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(100, None), (101, " ! "), (2, "a second text with the same id but other words in it")]
    texts = odd + [" ".join(rng.choices(vocab, k=60)) for _ in range(40)] + [f"pre {t.upper() if t else ''}, post {t}" for _, t in items]
    rows = list(enumerate(texts))
    df = D.contamination(make_docs(texts).select("doc_id", "text"), spark.createDataFrame(items, BENCH))
    assert got(df) == brute(rows, items)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_proximity(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    turned = "beta alpha gamma delta epsilon zeta eta theta iota kappa"
    r = {x["doc_id"]: x for x in D.contamination(make_docs([item, turned, "alpha beta"]).select("doc_id", "text"), spark.createDataFrame([(1, item)], BENCH)).collect()}
    assert [r[i]["contaminated"] for i in range(3)] == [True, False, False] and [r[i]["n_near_items"] for i in range(3)] == [1, 1, 0]


def test_empty_tables_repeated_and_missing_ids(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three")], BENCH)
    docs = make_docs([(1, "one two three"), (1, "one two three"), (1, "other"), (None, "x one two three")])
    rows = sorted((r["doc_id"] or -1, r["n_hit"]) for r in D.contamination(docs.select("doc_id", "text"), bench).collect())
    assert rows == [(-1, 3), (1, 0), (1, 3), (1, 3)]
    assert D.contamination(docs.limit(0).select("doc_id", "text"), bench).count() == 0
    assert not D.contamination(docs.select("doc_id", "text"), bench.limit(0)).where("contaminated").count()
    kept = D.drop_contaminated(docs, bench)
    assert [r["text"] for r in kept.collect()] == ["other"] and kept.columns == docs.columns


def test_proximity_against_brute_force(spark, make_docs):
    """Near items and exact ones of random texts, windows with repeated words among them, on either path of the joins."""
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(14)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 4, 10, 12])))) for i in range(25)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 50))) for _ in range(80)] + [f"a {t} b" for _, t in items]
    seen = Counter(w for t in texts for w in words(t))
    want = {}
    for d, t in enumerate(texts):
        w, near = words(t), set()
        for i, item in items:
            ws = words(item)
            for k in range(max(1, len(ws) - 9)):
                win = ws[k : k + 10]
                anchor = min(range(len(win)), key=lambda x: (seen[win[x]], x))
                if any(x == win[anchor] and set(win) <= set(w[max(0, p - 9) : p + 10]) for p, x in enumerate(w)):
                    near.add(i)
        want[d] = len(near)
    rows = D.contamination(make_docs(texts).select("doc_id", "text"), spark.createDataFrame(items, BENCH))
    assert {r["doc_id"]: r["n_near_items"] for r in rows.collect()} == want
    assert got(rows) == brute(list(enumerate(texts)), items)


def test_joins_of_large_sides(spark, make_docs, monkeypatch):
    """The same when nothing may be broadcast but hot keys."""
    monkeypatch.setattr(common, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = ["one two three four " * 3, "x one two y", "three four one", ""] * 10
    items = [(1, "one two"), (2, "three four one"), (3, "four")]
    df = D.contamination(make_docs(texts).select("doc_id", "text"), spark.createDataFrame(items, BENCH))
    assert got(df) == brute(list(enumerate(texts)), items)


def test_columns_named_like_the_stage_s_own(spark):
    docs = spark.createDataFrame([(1, "one two three", "r", "b"), (2, "clean", "r", "b")], "doc_id bigint, text string, row string, bad string")
    assert [tuple(r) for r in D.drop_contaminated(docs, spark.createDataFrame([(1, "two three")], BENCH)).collect()] == [(2, "clean", "r", "b")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = c.sql(D.OP3_SQL)
    have = D.op3_decontaminate(spark, f"/root/testdata/{sf}")
    assert sorted(have.columns) == sorted(want.columns)
    assert sorted(map(tuple, have.select(*want.columns).collect())) == sorted(want.fetchall())


def test_stage_leaves_only_what_its_result_needs(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    before = common.live_paths(spark)
    kept = D.drop_contaminated(docs, bench)
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in common.live_paths(spark) if p not in before} <= {"bad", "counts", "hot", "hot_side"} and kept.count()
