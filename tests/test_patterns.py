import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import patterns

TEXTS = ["mail a.b@c.org", "call (555) 123-4567", "ssn 123-45-6789", "666-12-3456", "card 4111-1111-1111-1111", "iban DE89370400440532013000", "10.0.0.1", "api_key: abcdefghijklmnop1234", "nothing", None]


def test_same_as_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for kind, pattern in {**patterns.PATTERNS, **patterns.EXTRA_PATTERNS}.items():
        got = [r[0] for r in df.select(patterns.has(F.col("t"), kind)).collect()]
        assert got == [bool(t and re.search(pattern, t)) for t in TEXTS], kind


def test_order_of_replacement(spark):
    df = spark.createDataFrame([("x 5234567890123456 y",), ("4111-1111-1111-1111",)], "t string")
    assert [r[0] for r in df.select(patterns.redact(F.col("t"))).collect()] == ["x ***-***-****123456 y", "****-****-****-****"]


def test_active_patterns():
    on = patterns.active_patterns(phones=False, custom={"badge": "B[0-9]+", "broken": "("})
    assert list(on) == ["email", "ssn", "credit_card", "api_key", "ip_address", "custom_badge"] and on["custom_badge"][1] == "***BADGE***"


def test_nested_values(spark):
    kind = T.StructType().add("a", T.ArrayType(T.StringType())).add("m", T.MapType(T.StringType(), T.StringType())).add("n", T.LongType())
    df = spark.createDataFrame([((["x@y.org"], {"k": "10.1.1.1"}, 5),)], T.StructType().add("s", kind))
    got = df.select(patterns.redact_nested(F.col("s"), kind)).first()[0]
    assert (got["a"], got["m"], got["n"]) == (["***@***"], {"k": "***.***.***.***"}, 5)


def test_whitelist_and_effectiveness(spark):
    df = spark.createDataFrame([("a@mail1.example.com",), ("b@real.org",), (None,)], "t string")
    assert [r[0] for r in df.select(patterns.found_kinds(F.col("t"), whitelist=[r"MAIL[0-9]+\."])).collect()] == [[], ["email"], []]
    assert patterns.effectiveness(df, ["t"]).first()["effectiveness"] == 0.0
    assert patterns.effectiveness(df.limit(0), ["t"]).first()["effectiveness"] == 100.0
