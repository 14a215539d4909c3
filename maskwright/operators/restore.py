"""Originals put back in the place of their fakes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.errors import Code, RestoreError
from maskwright.operators.mapping import decrypted


#: Tasks over which rows without a value are spread.
SPREAD = 1024
#: What stands for the original's hash where a fake has one original, and where nobody knows which of several is meant; hashes have 32 bytes.
PLAIN, UNKNOWN = b"", b"?"


def originals(mapping: DataFrame, key: str) -> DataFrame:
    """``column_name, masked_value, original, original_value_hash`` of the entries that can be restored, and ``status`` of all: ok, null, or unrestorable."""
    original = F.when(~F.col("is_null"), decrypted(F.col("original_value_encrypted"), key))
    status = F.when(F.col("is_null"), "null").when(original.isNull(), "unrestorable").otherwise("ok")
    return mapping.select("column_name", "masked_value", original.alias("original"), "original_value_hash", status.alias("status"))


def ambiguous(entries: DataFrame) -> DataFrame:
    """Fakes that stand for several originals: ``column_name, masked_value, originals``."""
    known = entries.where("not is_null").groupBy("column_name", "masked_value").agg(F.countDistinct("original_value_hash").alias("originals"))
    return known.where("originals > 1")


def _shared(marks: DataFrame) -> DataFrame:
    """The fakes that ``marks`` tell apart by row."""
    return marks.select("column_name", "masked_value").distinct()


def _known(entries: DataFrame, key: str, marks: DataFrame | None) -> DataFrame:
    """``column_name, masked_value, which, original``: what each fake stands for, once; ``which`` is the original's hash where ``marks`` have the fake, else PLAIN."""
    ok, which = originals(entries, key).where("status = 'ok'"), F.lit(PLAIN)
    if marks is not None:
        ok = ok.join(_shared(marks).withColumn("shared", F.lit(True)), ["column_name", "masked_value"], "left")
        which = F.when(F.col("shared"), F.col("original_value_hash")).otherwise(which)
    known = ok.withColumn("which", which).groupBy("column_name", "masked_value", "which").agg(F.min("original").alias("original"), F.countDistinct("original").alias("n"))
    return known.where("n = 1").drop("n")


def _which(rows: DataFrame, marks: DataFrame | None, row_key: str, column: Column, value: str) -> DataFrame:
    """``rows`` with ``__which``, as in ``_known``, of their fake ``value`` of ``column``; ``row_key`` is left out."""
    if marks is None:
        return rows.withColumn("__which", F.lit(PLAIN))
    own = marks.select(F.col("row_key").alias("__r"), F.col("column_name").alias("__c"), F.col("masked_value").alias("__m"), F.coalesce("original_value_hash", F.lit(UNKNOWN)).alias("__h"))
    found = rows.join(own, (F.col(row_key) == F.col("__r")) & (column == F.col("__c")) & (F.col(value) == F.col("__m")), "left")
    return found.withColumn("__which", F.coalesce("__h", F.lit(PLAIN))).drop(row_key, "__r", "__c", "__m", "__h")


def _row_key(marks: DataFrame) -> Column:
    return F.struct(*(F.col(c) for c in marks.schema["row_key"].dataType.names))


def restored(df: DataFrame, mapping: DataFrame, columns: Sequence[str], key: str, *, strict: bool = True, marks: DataFrame | None = None) -> DataFrame:
    """``df`` with the originals of ``columns``; values that the mapping does not know stay.

    A fake that stands for several originals is told apart by ``marks``, the
    ``row_marks`` of what was masked; a row that they don't have keeps such a
    fake.  Without them an original that is not in the mapping but shares its
    fake with one that is cannot be noticed.  With ``strict`` a fake of several
    originals that is not told apart, or an original that cannot be decrypted,
    is an error; else those values stay masked.
    """
    entries = mapping.where(F.col("column_name").isin(*columns))
    marks = marks if marks is None else marks.where(F.col("column_name").isin(*columns))
    if strict:
        several = ambiguous(entries)
        if marks is not None:
            untold = marks.where("original_value_hash is null").select("column_name", "masked_value").distinct()
            several = several.join(_shared(marks), ["column_name", "masked_value"], "left_anti").select("column_name", "masked_value").unionByName(untold)
        several = several.limit(10).collect()
        if several:
            raise RestoreError("fakes stand for several originals", Code.RESTORE_AMBIGUOUS, values=[(r["column_name"], r["masked_value"]) for r in several])
        if not originals(entries, key).where("status = 'unrestorable'").isEmpty():
            raise RestoreError("some originals are not stored under this key", Code.RESTORE_INCOMPLETE)
    known = _known(entries, key, marks)
    if marks is not None:
        df = df.withColumn("__row_key", _row_key(marks))  # as masked: a column of the key may be restored before others
    for c in columns:
        own = known.where(F.col("column_name") == c).select(F.col("masked_value").alias("__m"), F.col("which").alias("__w"), F.col("original").alias("__o"))
        # rows without a value find nothing: they are spread instead of meeting in one task
        spread = F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
        keyed = df.withColumn("__k", F.coalesce(F.col(c).cast("string"), spread))
        if marks is not None:
            keyed = keyed.withColumn("__r_k", F.col("__row_key"))
        told = _which(keyed, marks, "__r_k", F.lit(c), "__k")
        df = told.join(own, (F.col("__k") == F.col("__m")) & (F.col("__which") == F.col("__w")), "left").withColumn(c, F.coalesce("__o", c)).drop("__k", "__which", "__m", "__w", "__o")
    return df.drop("__row_key")


def rates(df: DataFrame, entries: DataFrame, columns: Sequence[str], key: str, marks: DataFrame | None = None) -> DataFrame:
    """By column how many values there are, how many ``restored`` puts back with these ``marks``, and the share in per cent; 100 where there are none."""
    ok = _known(entries, key, marks).select("column_name", "masked_value", F.col("which").alias("__which"), F.lit(True).alias("known"))
    values = df.select(*([] if marks is None else [_row_key(marks).alias("__row_key")]), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("masked_value")) for c in columns))).alias("x")).select(*([] if marks is None else ["__row_key"]), "x.*").where("masked_value is not null")
    told = _which(values, marks, "__row_key", F.col("column_name"), "masked_value")
    counts = told.groupBy("column_name", "masked_value", "__which").agg(F.count("*").alias("rows"))
    known = counts.join(ok, ["column_name", "masked_value", "__which"], "left").groupBy("column_name").agg(F.sum("rows").alias("n_values"), F.coalesce(F.sum(F.when(F.col("known"), F.col("rows"))), F.lit(0)).alias("restored"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string").join(known, "column_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("column_name", zero("n_values"), zero("restored"), F.coalesce(F.try_divide(100.0 * F.col("restored"), F.col("n_values")), F.lit(100.0)).alias("percent"))


def differences(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By column how many rows differ between two states of a table, matched by key; a missing row differs in all."""
    a = before.select(*key, *(F.col(c).alias(f"__a_{c}") for c in columns), F.lit(True).alias("__in_a"))
    b = after.select(*key, *(F.col(c).alias(f"__b_{c}") for c in columns), F.lit(True).alias("__in_b"))
    joined = a.join(b, list(key), "full_outer")
    missing = F.col("__in_a").isNull() | F.col("__in_b").isNull()

    def differ(c: str) -> Column:
        return F.sum(F.when(missing | ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), 1).otherwise(0))

    one = joined.agg(*(F.coalesce(differ(c), F.lit(0)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("differing")) for c in columns))).alias("x")).select("x.*")
