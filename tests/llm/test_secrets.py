import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F

from maskwright.llm import secrets as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(a, S.KINDS[k], b) for a, k, b in sorted(spans)]


def texts(odd):
    rng = random.Random(5)
    keys = ["password=hunter22", "PASSWD : 'abcdef", 'api_key":"x.y/z+1=', "token=abc", "ſecret=abcdefgh", "toKen=tokentoken=abcdef", "AKIA" + "Q" * 16, "xAKIAAKIA" + "7" * 15, "AKIA" + "Q" * 15, "0123456789abcdef01234567", "0123456789abcdef0123456", "secret=0123456789abcdef0123456789abcdef", "token=\U0001f600aaaaaa", "apikey=  zzzzzzz"]
    mixed = [" ".join(rng.choices([*keys, "é", "\U0001f600", "word,", "\n"], k=12)) for _ in range(30)]
    return [*odd, *keys, *mixed, "password=" * 3 + "abcdefg", "deadbeef" * 4000]


def test_base_spans_against_python(spark, make_docs, odd):
    all_texts = texts(odd)
    docs = make_docs(all_texts)
    rows = docs.select("doc_id", S.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
    for r in rows:
        assert [(s["start"], S.KINDS[s["kind"]], s["end"]) for s in r["b"]] == brute(all_texts[r["doc_id"]]), all_texts[r["doc_id"]]


def test_query_shape_and_digest(spark, make_docs, folder, odd):
    all_texts = texts(odd)
    got = {r["doc_id"]: r for r in S.op5_secrets(spark, folder(documents=make_docs(all_texts))).collect()}
    for i, t in enumerate(all_texts):
        base = brute(t)
        shown = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex"))
        assert set(filter(None, shown.split(","))) <= set(got[i]["spans"].split(","))


def test_battery_tells_random_strings_from_words(spark, make_docs):
    rng = random.Random(9)
    random_ones = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) + "7a" for n in (30, 40, 60, 100) for _ in range(10)]
    words = ["internationalisation2of3everything", "thequickbrownfoxjumpsoverthelazydog1", "Donaudampfschifffahrtsgesellschaft22", "a1a1a1a1a1a1a1a1a1a1a1a1a1", "aaaaaaaaaaaaaaaaaaaaaaaa1", "path/to/some/ordinary/file_name_2024"] * 5
    docs = make_docs([f"x {t} y" for t in [*random_ones, *words]])
    found = S.tested(docs, "doc_id")
    limits = S.discovery_limits(found)
    got = {r["doc_id"]: len(r["d"]) for r in found.select("doc_id", S.discoveries(F.col("candidates"), limits).alias("d")).collect()}
    assert sum(got[i] for i in range(40)) >= 36
    assert not any(got[i] for i in range(40, 70))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_redaction(spark, make_docs):
    docs = make_docs(["a password=hunter22 b", None, "clean", "token=0123456789abcdef0123456789abcdef end", "\U0001f600 AKIA" + "Q" * 16])
    got = {r["doc_id"]: r for r in S.redact(docs).collect()}
    assert [got[i]["text"] for i in range(5)] == ["a [SECRET] b", None, "clean", "[SECRET] end", "\U0001f600 [SECRET]"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
    assert S.redact(docs.limit(0)).count() == 0 and S.redact(docs).columns == docs.columns


def plain_tests(value):
    """The battery in plain Python: the corrected p-value against uniform symbols, and that against an ordinary string as its negative power of ten."""
    which = next((i for i, (_, pattern, _) in enumerate(S.ALPHABETS[:-1]) if re.match(pattern, value)), len(S.ALPHABETS) - 1)
    symbols = S.ALPHABETS[which][2]
    body = value.replace("=", "")
    if which == len(S.ALPHABETS) - 1:
        body = body.replace("-", "+").replace("_", "/")
    n, k, codes = len(body), len(symbols), [symbols.find(c) for c in body]
    middle = (k - 1) / 2
    squares = sum(c * c for c in Counter(body).values())
    turns = sum((a < k // 2) != (b < k // 2) for a, b in zip(codes, codes[1:]))
    product = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = (squares * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = min(1, 3 * min(tail(chi), tail((turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)), tail(product / ((k * k - 1) / 12 * math.sqrt(n - 1)))))
    # the ordinary string's moments, from its symbols' shares
    share = {c: S.SHARES[c] / sum(S.SHARES[d] for d in symbols) for c in symbols}
    two, three, low = sum(p**2 for p in share.values()), sum(p**3 for p in share.values()), sum(share[c] for c in symbols[: k // 2])
    mean = sum(p * (symbols.index(c) - middle) for c, p in share.items())
    var = sum(p * (symbols.index(c) - middle - mean) ** 2 for c, p in share.items())
    pairs, turn = n * (n - 1) / 2, 2 * low * (1 - low)
    sd = [
        math.sqrt(4 * (pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two**2))),
        math.sqrt((n - 1) * turn * (1 - turn) + 2 * (n - 2) * (turn / 2) * (1 - 2 * turn)),
        math.sqrt((n - 1) * ((var + mean**2) ** 2 - mean**4) + 2 * (n - 2) * mean**2 * var),
    ]
    z = [(n + 2 * pairs * two - squares) / sd[0], (turns - (n - 1) * turn) / sd[1], ((n - 1) * mean**2 - product) / sd[2]]
    w = [max(0, x) for x in (2 * pairs * (two - 1 / k) / sd[0], (n - 1) * (0.5 - turn) / sd[1], (n - 1) * mean**2 / sd[2])]
    size = math.sqrt(sum(x * x for x in w) + 2 * (w[0] * w[1] * 0.5 + w[0] * w[2] * 0.5 + w[1] * w[2] * 0.9))
    score = sum(a * b for a, b in zip(w, z)) / size
    ordinary = -math.log10(math.erfc(score / math.sqrt(2)) / 2) if score > 0 else 0.0
    return uniform, ordinary + (n * -math.log10(0.4) if which < 2 else 0)


def plain_spans(corpus):
    """All spans of each text: the base ones, and what Benjamini and Hochberg's procedure finds among the other strings."""
    found = {}
    for i, text in enumerate(corpus):
        base = brute(text)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
                found[i, m.start(), m.end()] = plain_tests(m[0])
    chosen = set()
    for low, high in zip(S.BANDS, [*S.BANDS[1:], 10**9]):
        band = {k: (u, p) for k, (u, p) in found.items() if low <= k[2] - k[1] < high}
        steps = {k: min(math.floor(p * S.STEP), S.STEPS) if u >= S.UNIFORM_LEAST else 0 for k, (u, p) in band.items()}
        best = None
        for rank, s in enumerate(sorted(steps.values(), reverse=True), 1):
            if s > 0 and 10 ** (-s / S.STEP) <= S.FALSE_DISCOVERIES * rank / len(band):
                best = s if best is None else min(best, s)
        chosen |= {k for k, (u, p) in band.items() if best is not None and u >= S.UNIFORM_LEAST and p >= best / S.STEP}
    return [sorted([(a, S.KINDS.index(k), b) for a, k, b in brute(t)] + [(a, 3, b) for j, a, b in chosen if j == i]) for i, t in enumerate(corpus)], found


def test_all_spans_against_a_plain_version(spark, make_docs, folder, odd):
    rng = random.Random(12)
    signs = string.ascii_letters + string.digits + "+/"
    word = lambda: "".join(rng.choices(list(S.SHARES), weights=list(S.SHARES.values()), k=rng.randint(20, 70)))
    key = lambda: "".join(rng.choices(rng.choice([signs, string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_uppercase + "234567"]), k=rng.randint(20, 120)))
    corpus = [*odd, *(" ".join(rng.choice([word, key, key, lambda: "word, é", lambda: "token=" + key()])() for _ in range(6)) for _ in range(120))]
    want, tests = plain_spans(corpus)
    assert sum(k == 3 for spans in want for _, k, _ in spans) > 100
    got = {r["doc_id"]: r["spans"] for r in S.op5_secrets(spark, folder(documents=make_docs(corpus))).collect()}
    near = {(i, a, b) for (i, a, b), (u, p) in tests.items() if abs(math.log10(u / S.UNIFORM_LEAST)) < 0.02 or abs(p * S.STEP - round(p * S.STEP)) < 0.2}  # the normal tail is within 1 %
    differ = 0
    for i, spans in enumerate(want):
        shown = {f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans} ^ set(filter(None, got[i].split(",")))
        differ += len(shown)
        assert all((i, int(x.split(":")[1]), int(x.split(":")[2])) in near for x in shown), (i, shown)
    assert differ <= 3


def test_long_texts_in_proportion(spark, make_docs):
    """Very many matches, and one very long string, of about a million characters each."""
    rng = random.Random(3)
    many = "token=abcdefgh \U0001f600 " * 50_000
    key = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000)) + "1a"
    both = " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=30)) + "1a password=hunter22" for _ in range(10_000))
    began = time.monotonic()
    rows = S.redact(make_docs([many, key, both])).collect()
    assert time.monotonic() - began < 120
    texts_ = {r["doc_id"]: r["text"] for r in rows}
    assert texts_[0] == "[SECRET] \U0001f600 " * 50_000 and texts_[1] == "[SECRET]" and texts_[2].count("[SECRET]") > 18_000 and "hunter22" not in texts_[2]


def test_columns_named_like_the_stage_s_own(spark):
    docs = spark.createDataFrame([(1, "a password=hunter22 b", "r", "s")], "doc_id bigint, text string, row string, spans string")
    assert [tuple(r) for r in S.redact(docs).collect()] == [(1, "a [SECRET] b", "r", "s")]
