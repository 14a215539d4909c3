"""Originals whose fakes are the same: the names here have equal 32-bit seeds, so their masked addresses are equal."""

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright.errors import RestoreError
from maskwright.functions.maskers import MaskSpec, masked
from maskwright.operators import mapping, restore
from maskwright.plans.queries import ORACLES, QUERIES
from maskwright.plans.sanitize import restore_tables, sanitize
from maskwright.sources import config as cfg
from maskwright.sources.catalog import Catalog

TWINS = [("Customer#000015928", "Customer#000052458"), ("Customer#000138111", "Customer#000146043")]
EMAIL = [MaskSpec("c_name", "email")]


@pytest.fixture
def twins(spark, tmp_path):
    """Customers of both pairs and one more, at keys that a mapping of a part has and others that it lacks, as a folder."""
    (a, b), (c, d) = TWINS
    rows = [(3, a), (4, b), (5, a), (6, a), (9, c), (12, d), (10, d), (7, c), (11, "Other"), (15, "Other")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def against_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall(), key=str)


def test_round_trip_of_shared_fakes(spark, twins):
    df = spark.read.parquet(f"{twins}/customer.parquet")
    fakes = {r["c_name"]: r["fake"] for r in masked(df, [MaskSpec("c_name", "email", output="fake")]).collect()}
    assert all(fakes[a] == fakes[b] for a, b in TWINS)
    against_sql(spark, twins, "restore_roundtrip")


def test_marks_are_of_shared_fakes_alone(spark, twins):
    """Rows of other fakes have no mark; a row that the marks lack, or whose key has two originals for the fake, keeps it."""
    df, key = spark.read.parquet(f"{twins}/customer.parquet"), mapping.new_key()
    marks, entries = mapping.row_marks(df, EMAIL, ["c_custkey"]), mapping.build_mapping(df, "t", EMAIL, "op", key)
    assert sorted(r["row_key"]["c_custkey"] for r in marks.collect()) == [3, 4, 5, 6, 7, 9, 10, 12]
    fewer = restore.restored(masked(df, EMAIL), entries, ["c_name"], key, marks=marks.where("row_key.c_custkey <> 4"))
    back = {r["c_custkey"]: r["c_name"] for r in fewer.collect()}
    assert "@" in back.pop(4) and back == {r["c_custkey"]: r["c_name"] for r in df.where("c_custkey <> 4").collect()}
    same = df.withColumn("c_custkey", F.when(F.col("c_custkey") == 4, 3).otherwise(F.col("c_custkey")))
    untold = mapping.row_marks(same, EMAIL, ["c_custkey"])
    with pytest.raises(RestoreError):
        restore.restored(masked(same, EMAIL), entries, ["c_name"], key, marks=untold)
    loose = restore.restored(masked(same, EMAIL), entries, ["c_name"], key, strict=False, marks=untold)
    assert loose.count() == 10 and sorted(r["c_custkey"] for r in loose.where("contains(c_name, '@')").collect()) == [3, 3]


def test_tables_of_shared_fakes_come_back(spark, tmp_path):
    """Short columns, white space that masking strips, and a masked key, restored whole."""
    rows = [(f"k{i}", f"value {i % 250:03}", " x" if i % 2 else "x", None if i % 3 else f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, v string, w string, n string")
    catalog = Catalog.of({"dbo.t": df}, {"dbo.t": ("id",)}, [])
    config = cfg.Config((cfg.PiiColumn("dbo", "t", "id", "email"), cfg.PiiColumn("dbo", "t", "v", "generic"), cfg.PiiColumn("dbo", "t", "w", "generic"), cfg.PiiColumn("dbo", "t", "n", "generic")))
    key = mapping.new_key()
    report = sanitize(spark, {"dbo.t": df}, config, catalog, str(tmp_path / "o"), key=key, operation_id="op")
    fake = spark.read.parquet(str(tmp_path / "o/op/tables/dbo.t"))
    assert report.successful and fake.select("v").distinct().count() < 250 and fake.select("w").distinct().count() == 1
    back = restore_tables(spark, str(tmp_path / "o"), "op", catalog, key, str(tmp_path / "b"))
    assert back.successful, back.errors
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "b/dbo.t")).collect()), key=str) == sorted(rows, key=str)


@pytest.fixture
def part(spark, tmp_path):
    """Customers of whom a mapping of every third key has one of the first pair and both of the second; no name stands at keys of both sorts."""
    (a, b), (c, d) = TWINS
    rows = [(3, a), (6, a), (4, b), (5, b), (7, b), (9, c), (12, d), (15, "Other"), (11, "More")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_a_part_is_restored_without_its_namesakes(spark, part):
    """An original that the mapping lacks does not come back as another that has its fake."""
    against_sql(spark, part, "restore_partial")


def test_rates_count_no_namesakes(spark, part):
    """What counts as restorable is what a restore puts back: five rows of nine, not the three whose fake another's original has."""
    against_sql(spark, part, "restore_rates")
    df, key = spark.read.parquet(f"{part}/customer.parquet"), mapping.new_key()
    entries = mapping.build_mapping(df.where("c_custkey % 3 = 0"), "t", EMAIL, "op", key)
    marks = mapping.row_marks(df, EMAIL, ["c_custkey"])
    got = restore.rates(masked(df, EMAIL), entries, ["c_name"], key, marks).first()
    back = restore.restored(masked(df, EMAIL), entries, ["c_name"], key, marks=marks)
    assert (got["n_values"], got["restored"]) == (9, 5) and back.where("not contains(c_name, '@')").count() == got["restored"]
