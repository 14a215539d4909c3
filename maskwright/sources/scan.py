"""Keyed scans.

A Spark scan is split by files or ranges, so pages are only needed to resume or
to report; they are filters on the key and a bounded top, which Spark keeps
per partition before it merges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.errors import Code, SourceError
from maskwright.sources.catalog import Catalog

#: Buckets of about equal size in which rows are numbered.
BUCKETS = 1024


class Paging(str, Enum):
    KEY = "key_based"
    COMPOSITE = "composite_key"
    OFFSET = "row_number"


def paging_of(df: DataFrame, key: Sequence[str]) -> Paging:
    """By key for one numeric column, by composite key for several, else by offset."""
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.NumericType):
        return Paging.KEY
    return Paging.COMPOSITE if len(key) > 1 else Paging.OFFSET


def select_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key first, then ``columns``, each once; only these are read."""
    missing = [c for c in (*key, *columns) if c not in df.columns]
    if missing:
        raise SourceError(f"no column {', '.join(missing)}", Code.COLUMN_NOT_FOUND)
    return df.select(*dict.fromkeys((*key, *columns)))


def keyset_page(df: DataFrame, key: Sequence[str], after: Sequence | None, n: int, columns: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows that follow ``after`` in the order of ``key``; from the beginning if that is None."""
    rows = select_columns(df, key, columns or df.columns)
    if after is not None:
        if len(key) == 1:
            rows = rows.where(F.col(key[0]) > F.lit(after[0]))
        else:
            # the first column alone prunes row groups, the struct decides
            rows = rows.where((F.col(key[0]) >= F.lit(after[0])) & (F.struct(*key) > F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, after, strict=True)))))
    return rows.orderBy(*key).limit(n)


def offset_page(df: DataFrame, order: Sequence[str], offset: int, n: int) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in the order of ``order``, which should name all columns to be stable."""
    return df.orderBy(*order).offset(offset).limit(n)


def batch_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` rows that each row falls in by its numeric ``key``, and the progress after it, in per cent.

    Quantiles of the key cut the rows into BUCKETS of about equal size, however
    the keys are spread; the buckets' counts give each its offset, and rows are
    numbered within buckets, so no task orders the whole table.  A row finds its
    bucket by bisection.  Rows without a key come in no batch.
    """
    keyed = df.select(key).where(F.col(key).isNotNull())
    kind = df.schema[key].dataType
    ends = keyed.agg(F.percentile_approx(key, [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS).alias("cuts"), F.count("*").alias("total")).first()
    cuts, total = sorted(set(ends["cuts"] or [])), ends["total"]
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    bounds = F.array(*map(F.lit, cuts)).cast(T.ArrayType(kind))
    below = lambda at, step: (at + step <= len(cuts)) & (F.get(bounds, at + step - 1) < F.col(key))
    bucket = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at)) if cuts else F.lit(0)
    placed = keyed.withColumn("__bucket", bucket)
    counts = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__bucket", before.alias("__before"))  # BUCKETS rows at most
    row = F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    numbered = placed.join(F.broadcast(offsets), "__bucket").select(key, row.alias("__row"))
    batch = F.floor((F.col("__row") - 1) / size) + 1
    done = F.least(batch * size, F.lit(total))
    return numbered.select(key, batch.cast("bigint").alias("batch_number"), F.round(100 * done / F.lit(max(total, 1)), 2).alias("progress"))


def extract_batches(df: DataFrame, key: Sequence[str], size: int, columns: Sequence[str] = (), after: Sequence | None = None) -> Iterator[DataFrame]:
    """Pages of ``size`` rows in the order of ``key`` until none is left; ``after`` is the key of the last row already taken, from which to resume.

    Each page is a filter on the key and a bounded top, whatever
    :func:`paging_of` calls the key; its last row's key, one row on the driver,
    begins the next.  A whole table is better read as one frame: pages are for
    consumers that can take so much at a time.
    """
    while True:
        page = keyset_page(df, key, after, size, columns)
        last = page.agg(F.max(F.struct(*key)).alias("k"), F.count("*").alias("n")).first()
        if not last["n"]:
            return
        yield page
        after = [last["k"][k] for k in key]


def sample_rows(df: DataFrame, columns: Sequence[str], n: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows with a value in any of ``columns``: at random, or the same each time by the hash of ``by``."""
    some = df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())
    return some.orderBy(F.sha2(F.col(by).cast("string"), 256) if by else F.rand(seed)).limit(n)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each frame; a count reads no column."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, rows and non_null of ``columns``, in one pass."""
    one = df.agg(F.count("*").alias("__rows"), *(F.count(c).alias(f"__n_{c}") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("__rows").alias("rows"), F.col(f"__n_{c}").alias("non_null")) for c in columns))).alias("x")).select("x.*")


def execute(spark: SparkSession, sql: str, args: dict | list | None = None, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of ``sql``; ``args`` are bound to its ``:names`` or ``?`` as values, never as text, and ``{names}`` stand for ``frames``."""
    return spark.sql(sql, args=args, **(frames or {}))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def read_database(spark: SparkSession, url: str, table: str, catalog: Catalog | None = None, *, partitions: int = 16, bounds: tuple[int, int] | None = None, **options) -> DataFrame:
    """A table over JDBC, read in ranges of its key if that is one column and ``bounds`` are given."""
    key = catalog.key_of(table) if catalog else ()
    if len(key) == 1 and bounds:
        options |= {"partitionColumn": key[0], "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def is_healthy(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1
