"""Integrity before and after masking: snapshots, orphans, comparison, report."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.errors import DataValidationError
from maskwright.functions.maskers import DOMAINS
from maskwright.functions.patterns import RESIDUAL, found_kinds
from maskwright.functions.seeds import value_hash
from maskwright.sources.catalog import ForeignKey

#: What masked values look like; residual checks pass over them.
MASKED = (r"@(?:" + "|".join(d.replace(".", r"\.") for d in DOMAINS) + r"|y\.co)$", r"^(?:\(555\) |555-?)[0-9]{3}-?[0-9]{4}$")


@dataclass(frozen=True)
class Limits:
    """What a comparison accepts, in per cent, and what it looks at: all rows, or a sample of so many."""

    null_delta: float = 0.0
    orphans: float = 0.0
    sample: int | None = None
    whitelist: tuple[str, ...] = MASKED
    exceptions: dict = field(default_factory=dict)
    fail_on_warning: bool = False

    def __post_init__(self):
        if not (0 <= self.null_delta <= 100 and 0 <= self.orphans <= 100):
            raise DataValidationError("percentages lie between 0 and 100")
        if self.sample is not None and self.sample < 1:
            raise DataValidationError("a sample has one row at least")


METRICS = "table_name string, column_name string, metric string, value bigint, text_value string"


def snapshot(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """row_count of the table, and null_count, max_length, max_bytes and data_type of ``columns``, in one pass and in long form."""
    wanted = [F.count("*").alias("rows")]
    for c in columns:
        value = F.col(c).cast("string")
        wanted += [F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0)).alias(f"n_{c}"), F.max(F.char_length(F.rtrim(value))).cast("bigint").alias(f"l_{c}"), F.max(F.octet_length(value)).cast("bigint").alias(f"b_{c}")]
    row = lambda column, metric, value, text=None: F.struct(F.lit(table).alias("table_name"), F.lit(column).cast("string").alias("column_name"), F.lit(metric).alias("metric"), value.cast("bigint").alias("value"), F.lit(text).cast("string").alias("text_value"))
    rows = [row(None, "row_count", F.col("rows"))]
    for c in columns:
        rows += [row(c, "null_count", F.col(f"n_{c}")), row(c, "max_length", F.col(f"l_{c}")), row(c, "max_bytes", F.col(f"b_{c}")), row(c, "data_type", F.lit(None), df.schema[c].dataType.simpleString())]
    return df.agg(*wanted).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def orphan_rows(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Rows of ``child`` whose key columns are all there and name no row of ``parent``, which may be the same table."""
    keys = parent.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent_columns))).distinct()
    own = child.dropna(how="any", subset=list(fk.child_columns))
    on = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk.child_columns)]
    return own.join(keys, on, "left_anti")


def orphan_counts(frames: dict[str, DataFrame], foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """By constraint: child_table, parent_table, orphans, and the child's rows with a whole key."""
    out = None
    for fk in foreign_keys:
        child = frames[fk.child]
        orphans = orphan_rows(child, frames[fk.parent], fk).agg(F.count("*").alias("orphans"))
        keyed = child.agg(F.count(F.when(sum((F.col(c).isNull().cast("int") for c in fk.child_columns), F.lit(0)) == 0, 1)).alias("keyed_rows"))
        one = orphans.join(keyed, how="cross").select(F.lit(fk.name).alias("constraint_name"), F.lit(fk.child).alias("child_table"), F.lit(fk.parent).alias("parent_table"), "orphans", "keyed_rows")  # one row beside one row
        out = one if out is None else out.unionByName(one)
    return out


def compared(before: DataFrame, after: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Issues between two snapshots: severity, code, table_name, column_name, message, delta.

    A table or row that is missing and a changed type are errors, changed nulls
    beyond the limit are warnings, longer values are notes.
    """
    limits = limits or Limits()
    a, b = (s.select("table_name", F.coalesce("column_name", F.lit("")).alias("column_name"), "metric", F.col("value").alias(f"{n}_value"), F.col("text_value").alias(f"{n}_text"), F.lit(True).alias(f"{n}_there")) for s, n in ((before, "pre"), (after, "post")))
    both = a.join(b, ["table_name", "column_name", "metric"], "full_outer")
    delta = F.coalesce("post_value", F.lit(0)) - F.coalesce("pre_value", F.lit(0))
    share = F.when(F.col("pre_value") == 0, F.when(F.col("post_value") == 0, 0.0).otherwise(100.0)).otherwise(100.0 * F.abs(delta) / F.col("pre_value"))
    gone = F.col("post_there").isNull()
    code = (
        F.when((F.col("metric") == "row_count") & gone, "TABLE_MISSING")
        .when((F.col("metric") == "row_count") & (delta != 0), "ROW_COUNT_MISMATCH")
        .when((F.col("metric") == "null_count") & ~gone & (share > limits.null_delta), "NULL_COUNT_MISMATCH")
        .when((F.col("metric") == "data_type") & ~F.col("pre_text").eqNullSafe(F.col("post_text")), "DATA_TYPE_CHANGED")
        .when((F.col("metric") == "max_length") & (delta > 0), "LENGTH_GREW")
    )
    severity = F.when(F.col("code").isin("TABLE_MISSING", "ROW_COUNT_MISMATCH", "DATA_TYPE_CHANGED"), "error").when(F.col("code") == "NULL_COUNT_MISMATCH", "warning").otherwise("info")
    message = F.concat(F.col("metric"), F.lit(": "), F.coalesce(F.col("pre_value").cast("string"), F.col("pre_text"), F.lit("none")), F.lit(" to "), F.coalesce(F.col("post_value").cast("string"), F.col("post_text"), F.lit("none")))
    issues = both.withColumn("code", code).where("code is not null")
    return issues.select(severity.alias("severity"), "code", "table_name", "column_name", message.alias("message"), delta.alias("delta"))


def compared_orphans(before: DataFrame, after: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Issues between two orphan counts: more orphans are an error, fewer a note."""
    limits = limits or Limits()
    both = before.select("constraint_name", F.col("orphans").alias("pre")).join(after.select("constraint_name", "child_table", "keyed_rows", F.col("orphans").alias("post")), "constraint_name")
    delta = F.col("post") - F.col("pre")
    over = (delta > 0) & (100.0 * F.col("post") > limits.orphans * F.col("keyed_rows"))
    severity = F.when(over, "error").otherwise("info")
    message = F.concat_ws(" ", F.col("constraint_name"), F.lit("orphans:"), F.col("pre").cast("string"), F.lit("to"), F.col("post").cast("string"))
    return both.where(delta != 0).select(severity.alias("severity"), F.lit("FK_ORPHANS").alias("code"), F.col("child_table").alias("table_name"), F.lit("").alias("column_name"), message.alias("message"), delta.alias("delta"))


def residual(table: str, df: DataFrame, columns: Sequence[str], limits: Limits | None = None) -> DataFrame:
    """Issues for personal data of RESIDUAL's kinds left in ``columns``, masked values aside: one for each column and kind.

    All rows are looked at, in one scan.  Where the limits name a sample, that
    many rows are, those of the least hashes of their values, whatever their order.
    """
    limits = limits or Limits()
    sample = df.select(*columns)
    if limits.sample is not None:
        sample = sample.orderBy(F.xxhash64(*columns)).limit(limits.sample)
    passed = lambda c: (*limits.whitelist, *limits.exceptions.get(f"{table}.{c}", ()))
    kinds = F.array(*(F.struct(F.lit(c).alias("column_name"), found_kinds(F.col(c).cast("string"), RESIDUAL, passed(c)).alias("kinds")) for c in columns))
    each = sample.select(F.explode(kinds).alias("x")).select("x.*")
    hits = each.select("column_name", F.explode("kinds").alias("kind")).groupBy("column_name", "kind").agg(F.count("*").alias("delta"))
    return hits.select(F.lit("error").alias("severity"), F.lit("PII_PATTERN_DETECTED").alias("code"), F.lit(table).alias("table_name"), "column_name", F.concat(F.col("kind"), F.lit(" pattern in "), F.col("delta").cast("string"), F.lit(" values")).alias("message"), "delta")


def leaks(masked_df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Values of a masked column that are originals of the mapping: the sure sign that they were not masked."""
    seen = mapping.where((F.col("column_name") == column) & ~F.col("is_null")).select(F.col("original_value_hash").alias("__h")).distinct()
    own = masked_df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), value_hash(F.col(column)).alias("__h"))
    return own.join(seen, "__h", "left_semi").groupBy("value").agg(F.count("*").alias("n"))


def severity_summary(issues: DataFrame) -> DataFrame:
    """Counts of error, warning and info in one row."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    return issues.agg(count("error"), count("warning"), count("info"))


def issues_by(issues: DataFrame, *by: str) -> DataFrame:
    """How many issues there are by ``by`` (column_name, table_name, severity, code), and their severities."""
    return issues.groupBy(*by).agg(F.count("*").alias("issues"), F.array_sort(F.collect_set("severity")).alias("severities"))


def null_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """By column how the nulls changed between two snapshots, and by how many per cent of what they were; 100 where there were none."""
    nulls = lambda s, name: s.where("metric = 'null_count'").select("table_name", "column_name", F.col("value").alias(name))
    both = nulls(before, "pre").join(nulls(after, "post"), ["table_name", "column_name"])
    delta = F.col("post") - F.col("pre")
    percent = F.when(F.col("pre") == 0, F.when(F.col("post") == 0, 0.0).otherwise(100.0)).otherwise(100.0 * F.abs(delta) / F.col("pre"))
    return both.select("table_name", "column_name", delta.alias("delta"), percent.alias("percent"))


def precision_losses(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose ``column`` would change, or become null, as ``kind``."""
    as_kind = F.col(column).try_cast(kind)
    exact = F.col(column).cast("decimal(38,10)")
    return df.where(F.col(column).isNotNull() & (as_kind.isNull() | (as_kind.cast("decimal(38,10)") != exact)))


def constraints_there(spark, frames: dict[str, DataFrame], foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """By constraint whether its tables and columns are there, with types that compare."""

    def there(fk: ForeignKey) -> bool:
        child, parent = frames.get(fk.child), frames.get(fk.parent)
        if child is None or parent is None or not set(fk.child_columns) <= set(child.columns) or not set(fk.parent_columns) <= set(parent.columns):
            return False
        return all(child.schema[c].dataType == parent.schema[p].dataType for c, p in zip(fk.child_columns, fk.parent_columns, strict=True))

    return spark.createDataFrame([(fk.name, there(fk)) for fk in foreign_keys], "constraint_name string, there boolean")


def counted(table: str, df: DataFrame, limit: int = 100_000_000, fraction: float = 0.01) -> DataFrame:
    """table_name, row_count and estimated: the count, or above ``limit`` rows, as the optimizer's statistics tell, that of a sample of the partitions' rows, scaled up."""
    known = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    if known.isDefined() and int(str(known.get())) > limit:
        counts = df.sample(fraction, seed=0).agg((F.count("*") / F.lit(fraction)).cast("bigint").alias("row_count"))
        return counts.select(F.lit(table).alias("table_name"), "row_count", F.lit(True).alias("estimated"))
    return df.agg(F.count("*").alias("row_count")).select(F.lit(table).alias("table_name"), "row_count", F.lit(False).alias("estimated"))


@dataclass
class Report:
    """The outcome of a comparison: PASS, WARNING or FAIL, with its issues (the first hundred; they are few or all alike)."""

    operation_id: str
    status: str
    counts: dict
    issues: list[dict]

    @classmethod
    def of(cls, operation_id: str, issues: DataFrame, limits: Limits | None = None) -> Report:
        counts = severity_summary(issues).first().asDict()
        failed = counts["error"] or (limits or Limits()).fail_on_warning and counts["warning"]
        status = "FAIL" if failed else "WARNING" if counts["warning"] else "PASS"
        shown = issues.orderBy("severity", "code", "table_name", "column_name").limit(100).collect()
        return cls(operation_id, status, counts, [r.asDict() for r in shown])

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(asdict(self), indent=indent, default=str)

    def to_html(self, title: str = "Integrity report") -> str:
        cells = ("severity", "code", "table_name", "column_name", "message")
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(i.get(c, '')))}</td>" for c in cells) + "</tr>" for i in self.issues)
        head = "".join(f"<th>{c}</th>" for c in cells)
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(self.operation_id)}: <b>{self.status}</b> {html.escape(str(self.counts))}</p><table><tr>{head}</tr>{rows}</table></body></html>"

    def export(self, folder: str | Path, kind: str = "both") -> list[str]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        out = []
        for ext, text in (("json", self.to_json), ("html", self.to_html)):
            if kind in (ext, "both"):
                path = Path(folder, f"integrity-{self.operation_id}.{ext}")
                path.write_text(text(), encoding="utf-8")
                out.append(str(path))
        return out
