"""What several operators of this subpackage share: staged tables and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest size, in bytes of its rows as measured, that a broadcast side may have.
BROADCAST_LIMIT = 32 << 20
#: A key that more rows than this share, and more than a HOT_KEYS-th of all, is hot, so there are HOT_KEYS hot keys at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
#: Bytes of the hot keys' rows up to which they are broadcast; beyond that each is dealt out to SALTS tasks.
HOT_LIMIT, SALTS = 8 << 20, 64
#: Elements that a scan of an array takes at once: appending copies what is there, so runs are kept short.
RUN = 64


_shipped: set[str] = set()


#: Rows and bytes of documents that go to a Python worker at once, in place of Spark's own defaults; 10,000 rows of long texts would take much memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(8 << 20))}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, as ``--py-files`` would, and set the size of batches for documents where the session has Spark's defaults."""
    context = spark.sparkContext
    for name, (default, ours) in BATCH.items():
        if not context.getConf().contains(name) and spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="maskwright-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only where that is unset on a local master
    (tests) a temporary folder is made and stored in the session, so that later
    calls agree; on a cluster a missing name is an error, as each executor would
    write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Paths handed out and not discarded yet, by application.
_live: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by :func:`discard` or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _live.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def live_paths(spark: SparkSession) -> list[str]:
    """The paths of this application that are still there."""
    return list(_live.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove staged tables that no result needs any more, and the shuffle files of what was computed for them: Spark does that itself, but only after a collection of garbage."""
    live = _live.get(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        if path in live:
            live.remove(path)
    gc.collect()  # Python's handles of plans go first
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, as a checkpoint does, but in compressed columns.  A lost
    executor costs nothing that was staged.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step, shown, kind: str) -> Column:
    """``shown(state, item)``, of the SQL type ``kind``, for each of ``items``, where ``step(state, item)`` is the state at the next one.

    Items are taken in runs of RUN, each gathered by itself, which keeps the
    time in proportion to their number for all arrays that fit in memory.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(state: Column, run: Column) -> Column:
        return F.aggregate(run, F.struct(state.alias("s"), none.alias("out")), lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["out"], shown(acc["s"], x)).alias("out")))

    def over(all_items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / RUN).cast("int")), lambda r: F.slice(all_items, r * RUN + 1, F.lit(RUN)))
        first = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(runs, first, lambda acc, run: let(within(acc["s"], run), lambda x: F.struct(x["s"].alias("s"), F.array_append(acc["out"], x["out"]).alias("out"))))["out"])

    return let(items, lambda x: F.when(F.size(x) > 0, over(x)).otherwise(none))


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df``, best a staged table, take in memory: what varies in length is measured on every row."""
    varying = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    text = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*varying)))), F.lit(0)) if varying else F.lit(0)
    one = df.agg(F.count("*").alias("n"), text.alias("b")).first()
    return one["n"] * 16 * (len(df.columns) + 1) + one["b"]


def small(df: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """Mark ``df``, a staged table, for broadcast if its rows as measured keep within BROADCAST_LIMIT; else leave it to a shuffle."""
    return F.broadcast(df) if (table_bytes(df) if n_bytes is None else n_bytes) <= BROADCAST_LIMIT else df


def keyed_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", n_bytes: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, a staged table with one row a key, whatever share of ``left`` one key holds; ``how`` is inner or left.

    A right side within BROADCAST_LIMIT is broadcast, so nothing is dealt by key.
    Else the rows of hot keys, HOT_KEYS at most and counted after partial sums,
    meet a broadcast of just those keys' rows where they are, or, if those take
    much, copies of them in SALTS tasks; only the others are dealt by key.
    """
    on = [on] if isinstance(on, str) else list(on)
    if (table_bytes(right) if n_bytes is None else n_bytes) <= BROADCAST_LIMIT:
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS)
    hot = staged(counts, "counts")
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(staged(hot.where(F.col("_rows") > left.count() // HOT_KEYS).select(*on), "hot"))
    cold = left.join(hot, on, "left_anti").join(right, on, how)
    own, of_hot = left.join(hot, on, "left_semi"), staged(right.join(hot, on, "left_semi"), "hot_side")
    if table_bytes(of_hot) <= max(BROADCAST_LIMIT, HOT_LIMIT):
        return cold.unionByName(own.join(F.broadcast(of_hot), on, how))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = own.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return cold.unionByName(dealt.join(of_hot.select("*", salt), [*on, "_salt"], how).drop("_salt"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)`` as ``(node, root)``, root the smallest node reachable.

    Each round takes, for each node, the least root among its neighbours' and
    then the root's own root, so that the rounds grow with the logarithm of the
    longest path at most in practice.  Minima are combined before they are
    shuffled, and the two joins by a neighbour and by a root, in which a hub or a
    large component would be one key, are :func:`keyed_join`.  Null ends and
    self-loops are dropped; an empty table gives an empty result.
    """
    kind = edges.schema["a"].dataType.simpleString()
    # the smaller end of an edge is a first guess of the larger end's root
    ends = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = staged(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).cast(kind).alias("root")), "labels")
    n_bytes = table_bytes(labels)
    for _ in range(max_rounds):
        seen = keyed_join(links, labels.select(F.col("node").alias("b"), "root"), "b", n_bytes=n_bytes).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = staged(labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "near")
        up = nearer.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = staged(keyed_join(nearer, up, "root", "left", n_bytes).select("node", "old", F.coalesce("top", "root").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
