import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.errors import MaskingError
from maskwright.functions import lengths, maskers
from maskwright.functions.maskers import MaskSpec, masked
from maskwright.functions.seeds import seed_u32, strip

GOLDEN = [
    ("john.doe@example.com", 1184727565, "user_469d820d@masked.dev", "(555) 672-4565", "656-22-3328", "hijklmnopqrstuvwxyzA"),
    ("(555) 123-4567", 2896480537, "user_aca4c919@placeholder.co", "(555) 848-2537", "396-60-2584", "bcdefghijklmno"),
    ("123-45-6789", 1578651723, "user_5e18504b@sample.io", "(555) 465-7723", "052-22-7759", "JKLMNOPQRST"),
    ("Ñandú Ö", 1021548484, "user_3ce397c4@fake.email", "(555) 554-4484", "748-72-1492", "CDEFGHI"),
    ("x", 743397997, "user_2c4f5a6d@placeholder.co", "(555) 639-7997", "372-99-8362", "r"),
    ("Customer#000000001", 24781696, "user_17a23800@sanitized.app", "(555) 778-5696", "489-75-0279", "WXYZ0123456789abcd"),
]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def fakes(spark, values, *specs):
    rows = masked(frame(spark, values), [MaskSpec("v", k, m, output=f"o{i}", params=p) for i, (k, m, p) in enumerate(specs)]).collect()
    return {r["v"]: tuple(r[f"o{i}"] for i in range(len(specs))) for r in rows}


def test_golden_values(spark):
    got = fakes(spark, [g[0] for g in GOLDEN], ("email", 255, {}), ("phone", 14, {}), ("ssn", 11, {}), ("generic", 255, {}))
    assert got == {g[0]: g[2:] for g in GOLDEN}
    seeds = {r[0]: r[1] for r in frame(spark, [g[0] for g in GOLDEN]).select("v", seed_u32(F.col("v"))).collect()}
    assert seeds == {g[0]: g[1] for g in GOLDEN}


@pytest.mark.parametrize(("kind", "most", "params", "want"), [("email", 24, {}, "u_17a238@sanitized.app"), ("email", 20, {}, "u_17a238@y.co"), ("email", 13, {}, "u_17a238@y.co"), ("email", 12, {}, "x@y.co"), ("email", 6, {}, "x@y.co"), ("phone", 12, {}, "555-778-5696"), ("phone", 10, {}, "5557785696"), ("ssn", 9, {}, "489750279"), ("generic", 255, {"character_class": "alpha"}, "efghijklmnopqrstuv"), ("generic", 255, {"character_class": "numeric"}, "678901234567890123")])
def test_shorter_columns(spark, kind, most, params, want):
    assert fakes(spark, ["Customer#000000001"], (kind, most, params))["Customer#000000001"] == (want,)


def test_strip_takes_unicode_white_space(spark):
    values = ["  a b\t", "  x　", "\x1ff\x85", "", " "]
    assert [r[0] for r in frame(spark, values).select(strip(F.col("v"))).collect()] == [v.strip() for v in values]


def test_equal_after_stripping_means_equal_fakes(spark):
    got = fakes(spark, ["  ann ", "ann"], ("email", 255, {}), ("ssn", 11, {}))
    assert got["  ann "] == got["ann"]


def test_long_values_are_seeded_by_beginning_and_length(spark):
    long = "q" * 10_241
    want = int(hashlib.sha256(f"42_{'q' * 1024}_len_10241".encode()).hexdigest()[:8], 16)
    assert frame(spark, [long]).select(seed_u32(F.col("v"))).first()[0] == want


def test_null_stays_null_or_fails_where_not_allowed(spark):
    df = frame(spark, [None, "a"])
    assert [r[0] for r in masked(df, [MaskSpec("v", "email")]).orderBy("v").collect()][0] is None
    with pytest.raises(Exception, match="not nullable"):
        masked(df, [MaskSpec("v", "email", nullable=False)]).collect()


def test_white_space_alone_cannot_be_masked_generically(spark):
    with pytest.raises(Exception, match="nothing to mask"):
        masked(frame(spark, ["  "]), [MaskSpec("v", "generic")]).collect()


def test_too_short_and_unknown_are_refused():
    for kind, most in (("email", 5), ("phone", 9), ("ssn", 8), ("name", 1)):
        with pytest.raises(MaskingError):
            MaskSpec("v", kind, most)
    with pytest.raises(MaskingError):
        MaskSpec("v", "horoscope")


def test_wrong_column_or_type(spark):
    with pytest.raises(MaskingError):
        masked(frame(spark, ["a"]), [MaskSpec("w", "email")])
    with pytest.raises(MaskingError):
        masked(spark.range(1), [MaskSpec("id", "email")])


def test_names_keep_titles_and_hyphens(spark):
    got = fakes(spark, ["Dr. Mary-Jane Roe Jr.", "Bob"], ("name", 60, {}), ("name", 12, {}), ("name", 4, {}), ("name", 3, {}), ("name", 2, {}))
    full = got["Dr. Mary-Jane Roe Jr."][0]
    assert full.split()[0] in maskers.PREFIXES and full.split()[-1] in maskers.SUFFIXES and "-" in full
    assert all(len(x) <= m for v in got.values() for x, m in zip(v, (60, 12, 4, 3, 2), strict=True))


def test_social_security_numbers_are_valid(spark):
    got = fakes(spark, [f"v{i}" for i in range(3000)], ("ssn", 11, {}))
    for (n,) in got.values():
        area, group, serial = n.split("-")
        assert 1 <= int(area) <= 899 and area != "666" and group != "00" and serial != "0000"


def test_keep_ends(spark):
    got = {k: v[0] for k, v in fakes(spark, ["", "a", "ab", "abcdef"], ("keep_ends", 255, {})).items()}
    assert got[""] == "" and len(got["a"]) == 1 and len(got["ab"]) == 2
    assert got["abcdef"][0] == "a" and got["abcdef"][-1] == "f" and len(got["abcdef"]) == 6


def test_own_masker(spark):
    maskers.register_masker("stars", lambda value, seed, most, **_: F.repeat(F.lit("*"), F.char_length(value)))
    assert fakes(spark, ["abc"], ("stars", 255, {}))["abc"] == ("***",) and "stars" in maskers.registered_kinds()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aé€𝄞 ", max_size=12), min_size=1, max_size=6), st.integers(0, 14))
def test_bytes_are_cut_between_characters(spark, values, most):
    rows = frame(spark, values).select("v", lengths.byte_prefix(F.col("v"), most).alias("p")).collect()
    assert all(r["p"] == r["v"].encode()[:most].decode("utf-8", "ignore") for r in rows)


def test_fixed_columns_are_padded(spark):
    rows = frame(spark, ["é", "abc"]).select(lengths.fit(F.col("v"), 4, unicode=False, fixed=True).alias("b"), lengths.fit(F.col("v"), 4, fixed=True).alias("c")).collect()
    assert all(len(r["b"].encode()) == 4 and len(r["c"]) == 4 for r in rows)


def test_masking_does_not_shuffle(spark, data):
    df = masked(spark.read.parquet(f"{data}/customer.parquet"), [MaskSpec("c_name", "email")])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
