"""The mapping store: which fake stands for which original, encrypted."""

from __future__ import annotations

import os
import re
import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.errors import Code, MappingError
from maskwright.functions.maskers import MaskSpec, masked
from maskwright.functions.seeds import value_hash

KEY_VARIABLE = "SANITIZATION_MAPPING_ENCRYPTION_KEY"

SCHEMA = T.StructType(
    [
        T.StructField("operation_id", T.StringType(), False),
        T.StructField("schema_name", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("original_value_hash", T.BinaryType(), False),
        T.StructField("original_value_encrypted", T.BinaryType()),
        T.StructField("masked_value", T.StringType()),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("is_null", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)


def new_key() -> str:
    """A random key of 32 bytes in hexadecimal."""
    return secrets.token_bytes(32).hex()


def is_key_valid(key: str) -> bool:
    try:
        return len(bytes.fromhex(key)) in (16, 24, 32)
    except ValueError:
        return False


def load_key(key: str | None = None) -> str:
    found = key or os.environ.get(KEY_VARIABLE)
    if not found or not is_key_valid(found):
        raise MappingError("no valid encryption key", Code.MAPPING_KEY_MISSING, action=f"set {KEY_VARIABLE} to 16, 24 or 32 bytes in hexadecimal")
    return found


def encrypted(value: Column, key: str) -> Column:
    """AES-GCM of the value's UTF-8 with a new nonce each time; null stays null.  The key is a literal of the plan: where plans are shown or logged, let spark.sql.redaction.string.regex match it."""
    return F.aes_encrypt(value, F.unhex(F.lit(key)), F.lit("GCM"))


def decrypted(value: Column, key: str) -> Column:
    """The original, or null where it was not encrypted with this key."""
    return F.try_aes_decrypt(value, F.unhex(F.lit(key)), F.lit("GCM")).cast("string")


def valid_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name))


def build_mapping(df: DataFrame, table: str, specs: Sequence[MaskSpec], operation_id: str, key: str | None = None, created_at: str | None = None) -> DataFrame:
    """One row per distinct original of each column of ``specs``, null included.

    Originals are made distinct before anything is encrypted, and partial
    distinct sets are formed before the shuffle.  On a stream an entry comes once,
    by a state that holds the hashes alone, never an original.  Without a key
    originals are not stored and cannot be restored.
    """
    schema, _, name = table.rpartition(".")
    both = masked(df, [MaskSpec(s.column, s.kind, s.most, s.seed, s.unicode, s.fixed, s.nullable, s.params, f"__m_{s.column}") for s in specs])
    pairs = both.select(F.explode(F.array(*(F.struct(F.lit(s.column).alias("column_name"), F.lit(df.schema[s.column].dataType.simpleString()).alias("data_type"), F.col(s.column).alias("original"), F.col(f"__m_{s.column}").alias("masked_value")) for s in specs))).alias("x")).select("x.*")
    pairs = pairs if df.isStreaming else pairs.distinct()
    cipher = encrypted(F.col("original"), key) if key else F.lit(None).cast("binary")
    entries = pairs.select(
        F.lit(operation_id).alias("operation_id"),
        F.lit(schema or "dbo").alias("schema_name"),
        F.lit(name).alias("table_name"),
        "column_name",
        value_hash(F.col("original")).alias("original_value_hash"),
        cipher.alias("original_value_encrypted"),
        "masked_value",
        "data_type",
        F.col("original").isNull().alias("is_null"),
        (F.to_timestamp(F.lit(created_at)) if created_at else F.current_timestamp()).alias("created_at"),
    )
    return entries.dropDuplicates(["column_name", "original_value_hash", "is_null"]) if df.isStreaming else entries


def row_marks(df: DataFrame, specs: Sequence[MaskSpec], by: Sequence[str]) -> DataFrame:
    """Which original is meant in the rows whose fake stands for several: ``row_key`` (a struct of the columns ``by`` as they are once masked), ``column_name, masked_value, original_value_hash``.

    Fakes come from 32 bits, so among some hundred thousand originals a few are
    shared, and the fake alone does not tell whose it is.  ``df`` is all of what
    is masked, also where a mapping is made of a part.  The hash is null where
    rows of one key have the same fake for different originals.  These rows are
    few unless a column is short; they are as confidential as the mapping.
    """
    both = masked(df, [MaskSpec(s.column, s.kind, s.most, s.seed, s.unicode, s.fixed, s.nullable, s.params, f"__m_{s.column}") for s in specs])
    own = {s.column for s in specs}
    row_key = F.struct(*(F.col(f"__m_{c}" if c in own else c).alias(c) for c in by)).alias("row_key")
    rows = both.select(row_key, F.explode(F.array(*(F.struct(F.lit(s.column).alias("column_name"), F.col(s.column).alias("original"), F.col(f"__m_{s.column}").alias("masked_value")) for s in specs))).alias("x")).select("row_key", "x.*").where("original is not null")
    shared = rows.groupBy("column_name", "masked_value").agg(F.min("original").alias("a"), F.max("original").alias("b")).where("a <> b").select("column_name", "masked_value")
    marked = rows.join(shared, ["column_name", "masked_value"], "left_semi").withColumn("hash", value_hash(F.col("original")))
    one = marked.groupBy("row_key", "column_name", "masked_value").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    return one.select("row_key", "column_name", "masked_value", F.when(F.col("a") == F.col("b"), F.col("a")).alias("original_value_hash"))


def table_info(entries: DataFrame) -> DataFrame:
    """By schema, table and column of the store: entries, distinct originals, how many are encrypted or null, and the latest time."""
    return entries.groupBy("schema_name", "table_name", "column_name").agg(
        F.count("*").alias("entries"),
        F.countDistinct("original_value_hash").alias("originals"),
        F.count(F.when(F.col("original_value_encrypted").isNotNull(), 1)).alias("encrypted"),
        F.count(F.when(F.col("is_null"), 1)).alias("nulls"),
        F.max("created_at").alias("latest"),
    )


def broken_entries(entries: DataFrame) -> DataFrame:
    """Entries that break the store's rules, with ``rule``: names that are not there, a hash that is no SHA-256, an original stored for null, or a null with a fake."""
    rule = (
        F.when(F.coalesce(F.trim("operation_id"), F.lit("")) == "", "NO_OPERATION")
        .when((F.coalesce(F.trim("table_name"), F.lit("")) == "") | (F.coalesce(F.trim("column_name"), F.lit("")) == ""), "NO_COLUMN")
        .when(F.col("original_value_hash").isNull() | (F.octet_length("original_value_hash") != 32), "BAD_HASH")
        .when(F.col("is_null") & F.col("original_value_encrypted").isNotNull(), "ORIGINAL_OF_NULL")
        .when(~F.col("is_null") & F.col("masked_value").isNull(), "NO_FAKE")
    )
    return entries.withColumn("rule", rule).where("rule is not null")


def store(mapping: DataFrame, path: str) -> None:
    """Append to the store, dealt by operation, schema and table so that lookups read their part alone."""
    if not broken_entries(mapping).isEmpty():
        raise MappingError("entries break the store's rules")
    mapping.write.mode("append").partitionBy("operation_id", "schema_name", "table_name").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def lookup(mapping: DataFrame, operation_id: str | None = None, schema: str | None = None, table: str | None = None, column: str | None = None, original: str | None = None, most: int | None = None) -> DataFrame:
    """Entries by any of operation, schema, table, column and original, oldest first."""
    wanted = {"operation_id": operation_id, "schema_name": schema, "table_name": table, "column_name": column}
    for name, value in wanted.items():
        if value is not None:
            mapping = mapping.where(F.col(name) == value)
    if original is not None:
        mapping = mapping.where(F.col("original_value_hash") == value_hash(F.lit(original)))
    ordered = mapping.orderBy("created_at", "column_name", "original_value_hash")
    return ordered if most is None else ordered.limit(most)


def stats(mapping: DataFrame) -> DataFrame:
    """By operation: entries, tables, columns, averages, and when it began and ended."""
    table = F.struct("schema_name", "table_name")
    one = mapping.groupBy("operation_id").agg(
        F.count("*").alias("entries"),
        F.countDistinct(table).alias("tables"),
        F.countDistinct(F.struct("schema_name", "table_name", "column_name")).alias("columns"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("completed_at"),
        F.count(F.when(F.col("original_value_encrypted").isNotNull(), 1)).alias("encrypted"),
    )
    average = lambda c: F.coalesce(F.try_divide(F.col("entries"), F.col(c)), F.lit(0.0))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return one.select("*", average("tables").alias("per_table"), average("columns").alias("per_column"), seconds.alias("seconds"))
