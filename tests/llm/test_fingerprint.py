import hashlib
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import fingerprint as P


def canonical(text):
    text = unicodedata.normalize("NFKC", text)
    text = unicodedata.normalize("NFKC", text.upper().lower())
    for c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   ":
        text = text.replace(c, " ")
    return " ".join(x for x in text.split(" ") if x)


POOL = [chr(c) for c in (*range(0x300, 0x345), *range(0x41, 0x7B), *range(0xC0, 0x180), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40), *range(0xFF00, 0xFF9F), *range(0x2100, 0x2140), 0x9BE, 0x9C7, 0x1E9B, 0x5B0, 0xFB1D, 0x1D15E, 0xA0, 0x2026, 0xFDFA, 0xF900, 0x200D, 9, 10, 32, 0x2028)]


def test_normalisation_of_marks_syllables_and_compatibility(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(POOL, k=rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", P.nfkc(F.col("t")).alias("n")).collect():
        assert r["n"] == unicodedata.normalize("NFKC", r["t"]), ascii(r["t"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in df.select("t", P.nfkc(F.col("t")).alias("n")).collect())


def test_what_is_folded(spark):
    pairs = [("Straße", "STRASSE"), ("été", "ÉTÉ"), (" a \n b", "a b "), ("ﬁn", "FIN"), ("", " \t"), ("각", "각"), ("Ａ", "a")]
    df = spark.createDataFrame(pairs + [("a", "b")], "x string, y string")
    same = [r["s"] for r in df.select((P.digest(P.canonical(F.col("x"))) == P.digest(P.canonical(F.col("y")))).alias("s")).collect()]
    assert same == [True] * len(pairs) + [False]


def run(spark, docs, folder):
    return {r["doc_id"]: r for r in P.op6_fingerprint(spark, folder(documents=docs)).collect()}


def test_edits_and_likenesses(spark, make_docs, folder, odd):
    texts = [*odd, "abcdefgh", "ABCDEFGH", "wxyz \U0001f600"]
    ids = [i * 5000 - 7000 for i in range(len(texts))]  # over many blocks
    got = run(spark, make_docs(list(zip(ids, texts, strict=True))), folder)
    full = [t or "" for t in texts]
    for k, i in enumerate(ids):
        text, after = full[k], full[(k + 1) % len(full)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == float(canonical(text) == canonical(after))
        assert got[i]["near_edited"] == float(canonical(text) == canonical(edited))
        for m, j in enumerate(ids):
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (canonical(text) == canonical(full[m]))


def test_one_row_repeated_rows_and_missing_ids(spark, make_docs, folder, tmp_path):
    one = run(spark, make_docs([(7, "abcdefgh")]), folder)
    assert one[7]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[7]["near_next"] == 1.0
    docs = make_docs([(1, "x"), (1, "x"), (None, "abcd"), (2, "y")])
    docs.write.parquet(str(tmp_path / "more/documents.parquet"))
    rows = P.op6_fingerprint(spark, str(tmp_path / "more")).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["near_next"]) for r in rows) == [(-1, 4, 0.0), (1, 1, 0.0), (1, 1, 1.0), (2, 1, 0.0)]


def test_empty_table(spark, make_docs, folder):
    assert run(spark, make_docs(["x"]).limit(0), folder) == {}


def test_equal_digests_of_different_texts_are_told_apart(spark, make_docs, folder, monkeypatch):
    monkeypatch.setattr(P, "digest", lambda canon: F.left(F.sha2(canon, 256), F.lit(1)))
    texts = [f"text {i}" for i in range(40)] + ["TEXT 1"]
    got = run(spark, make_docs(texts), folder)
    assert len({r["fingerprint"] for r in got.values()}) == 40 and got[1]["fingerprint"] == got[40]["fingerprint"]
    assert got[40]["near_edited"] == 1.0 or got[40]["edited_fingerprint"] != got[40]["fingerprint"]


def test_no_python_runs(spark, make_docs):
    df = make_docs(["a"]).select(P.digest(P.canonical(F.col("text"))))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_write_out_the_tables(spark, make_docs):
    """The driver keeps the text of every plan that ran."""
    df = make_docs(["a"]).select(P.digest(P.canonical(F.col("text"))).alias("fp"))
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 100_000


def test_ids_that_are_no_numbers(spark, tmp_path):
    """Order is that of the strings; over many blocks."""
    texts = {f"d{i:03}": f"text number {i} of the many" for i in range(600)} | {"z": "last", "": "first of all"}
    spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["edited_sha256"] for r in P.op6_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        q = len(text) // 4
        assert got[i] == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()


def test_edited_texts_are_compared_too(spark, make_docs, folder, monkeypatch):
    """Digests of one hexadecimal digit: an edited text is only like what has the same bytes."""
    monkeypatch.setattr(P, "digest", lambda canon: F.left(F.sha2(canon, 256), F.lit(1)))
    texts = [f"{i} text {i * i} and more of it {i}" for i in range(60)]
    got = run(spark, make_docs(texts), folder)
    for i, text in enumerate(texts):
        after, q = texts[(i + 1) % 60], len(text) // 4
        edited = canonical(text[: len(text) - q] + after[:q])
        assert got[i]["near_edited"] == float(edited == canonical(text)) and got[i]["near_next"] == 0.0
        assert all((got[i]["edited_fingerprint"] == got[j]["fingerprint"]) == (edited == canonical(texts[j])) for j in range(60))


def test_long_runs_of_marks(spark):
    """Time in proportion to the run: twenty thousand marks in a row."""
    text = "e" + "\u0301\u0316" * 10_000 + "x"
    assert spark.createDataFrame([(text,)], "t string").select(P.nfkc(F.col("t"))).first()[0] == unicodedata.normalize("NFKC", text)
