"""Updates by key, and writes that show whole results or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.errors import Code, UpdateError


def update_by_key(target: DataFrame, updates: DataFrame, key: Sequence[str], computed: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """``target`` with the values of ``updates(key..., columns...)``, null among them; computed columns keep theirs.

    Of the rows of ``updates`` that repeat a key the one of the greatest ``order``
    wins, as a whole; if several share that, the greatest of their values.
    Without an ``order``, rows of one key that differ are an error when the result
    is read, and rows that are all alike count once.  Keys that the target lacks
    and null keys change nothing.
    """
    if not key:
        raise UpdateError("an update needs a key", Code.PRIMARY_KEY_MISSING)
    given = [c for c in updates.columns if c != order or c in target.columns]
    unknown = [c for c in given if c not in target.columns]
    if unknown or any(k not in updates.columns for k in key):
        raise UpdateError(f"columns that are not there: {', '.join(unknown) or 'key'}")
    changed = [c for c in given if c not in key and c not in computed]
    if not changed:
        raise UpdateError("nothing to update but computed columns")
    values = F.struct(*changed)
    rows = updates.select(*key, values.alias("__new"), *([F.struct(F.col(order).alias("o"), values.alias("v")).alias("__order")] if order else []))
    if order:
        single = rows.groupBy(*key).agg(F.max("__order")["v"].alias("__new"))
    else:
        one, alike = F.max("__new"), F.min("__new").eqNullSafe(F.max("__new"))
        single = rows.groupBy(*key).agg(F.when(alike, one).otherwise(F.raise_error(F.concat(F.lit("updates differ for key "), F.to_json(F.struct(*key)))).cast(rows.schema["__new"].dataType)).alias("__new"))
    joined = target.join(single, list(key), "left")
    return joined.select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in target.columns))


def update_table(spark: SparkSession, path: str, updates: DataFrame, key: Sequence[str], computed: Sequence[str] = (), order: str | None = None) -> int:
    """Update the Parquet table at ``path`` and return how many of its rows had an update; a failure leaves it as it was."""
    target = spark.read.parquet(path)
    out = update_by_key(target, updates, key, computed, order)
    hit = target.join(updates.select(*key).distinct(), list(key), "left_semi").count()
    staged_write(out, path, mode="overwrite")
    return hit


def replace_values(df: DataFrame, column: str, replacements: DataFrame) -> DataFrame:
    """``column`` replaced at once by ``replacements(original, replacement)``; what is not listed stays."""
    listed = replacements.select(F.col("original").alias("__o"), F.col("replacement").alias("__r")).dropDuplicates(["__o"])
    joined = df.join(listed, df[column] == F.col("__o"), "left")
    return joined.withColumn(column, F.coalesce("__r", column)).drop("__o", "__r")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def staged_write(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write ``df`` beside ``path`` and put it in place when it is whole.

    The target is never read and written at once, and a failed job leaves it as
    it was.  ``mode`` overwrite replaces what is there.
    """
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    if mode == "error" and fs.exists(at):
        raise UpdateError(f"{path} is there already", Code.STAGING_EXISTS)
    beside, old = path.rstrip("/") + ".__staged", path.rstrip("/") + ".__old"
    _, staged_at = _file_system(spark, beside)
    _, old_at = _file_system(spark, old)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(beside)
    if fs.exists(at):
        fs.delete(old_at, True)
        fs.rename(at, old_at)
    try:
        if not fs.rename(staged_at, at):
            raise UpdateError(f"{path} cannot be put in place")
    except Exception:
        if fs.exists(old_at) and not fs.exists(at):
            fs.rename(old_at, at)
        raise
    fs.delete(old_at, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table written by :func:`staged_write` is in place, for resuming."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")
