"""The whole of masking and restoring a set of tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.errors import Code, ConfigError, EngineError, MappingError
from maskwright.functions.maskers import MAX_LENGTH, MaskSpec, masked
from maskwright.operators import integrity, mapping, restore, sink
from maskwright.operators.configcheck import issues
from maskwright.operators.fkgraph import FkGraph, same_masker
from maskwright.sources.catalog import Catalog, normal_name
from maskwright.sources.config import MASKER_OF, Config


#: What may go wrong with one table without ending a run: the engine's own errors and all that Spark raises.
TABLE_ERRORS = (EngineError, PySparkException, Py4JJavaError)


@dataclass
class TableProgress:
    table: str
    status: str = "pending"
    rows: int = 0
    values_masked: int = 0
    error: str | None = None


@dataclass
class RunReport:
    operation_id: str
    dry_run: bool
    tables: list[TableProgress] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    integrity: integrity.Report | None = None

    @property
    def successful(self) -> bool:
        return not self.errors and all(t.status in ("completed", "skipped") for t in self.tables)


def specs_of(config: Config, catalog: Catalog, table: str) -> list[MaskSpec]:
    """How the configured columns of a table are masked, by their declared types.  Computed columns are left alone."""
    out = []
    for c in config.columns_of(table):
        info = catalog.table(table).columns[c.column]
        if info.computed:
            continue
        kind = MASKER_OF[c.kind]
        params = {"character_class": c.character_class} if kind == "generic" else {}
        # declared types that Spark has made up say nothing of a length
        out.append(MaskSpec(c.column, kind, MAX_LENGTH if info.max_length in (None, -1) else info.max_length, config.seed, info.unicode, info.fixed, c.nullable, params))
    return out


def fingerprint(config: Config) -> str:
    """A stable digest of a configuration, by which a resumed run is held to the same one."""
    canonical = json.dumps([(*c.key, c.kind, c.nullable, c.character_class) for c in config.columns] + [config.seed], sort_keys=True)
    return hashlib.sha256(canonical.encode()).hexdigest()


def dry_run(frames: dict[str, DataFrame], config: Config, catalog: Catalog, n: int = 3) -> DataFrame:
    """Per column ``n`` originals beside their fakes: table_name, column_name, original, masked."""
    out = []
    for table in config.tables():
        df = frames[table]
        for s in specs_of(config, catalog, table):
            some = df.where(F.col(s.column).isNotNull()).select(s.column).orderBy(s.column).limit(n)
            both = masked(some, [MaskSpec(s.column, s.kind, s.most, s.seed, s.unicode, s.fixed, s.nullable, s.params, "masked")])
            out.append(both.select(F.lit(table).alias("table_name"), F.lit(s.column).alias("column_name"), F.col(s.column).alias("original"), "masked"))
    return reduce(DataFrame.unionByName, out)


def sanitize(spark: SparkSession, frames: dict[str, DataFrame], config: Config, catalog: Catalog, folder: str, *, key: str | None = None, operation_id: str | None = None, progress: Callable[[TableProgress], None] | None = None) -> RunReport:
    """Mask every configured table of ``frames`` into ``folder`` and store the mapping there.

    Tables go parents first.  Each is one projection of its scan, written beside
    its place and then moved, so a failed table leaves nothing; the others go
    on.  A run with the id of an earlier one and the same configuration takes up
    where that stopped.  A table without a key is skipped, as its rows could not
    be matched again.
    """
    found = issues(config, catalog)
    fatal = [f"{t}.{c}: {m}" for severity, _, t, c, m in found if severity == "error"]
    if fatal:
        raise ConfigError("the configuration does not fit the tables", issues=fatal)
    report = RunReport(operation_id or uuid.uuid4().hex, config.dry_run)
    report.warnings += [f"{t}.{c}: {m}" for severity, _, t, c, m in found if severity == "warning"]
    kinds = {(c.qualified_table, c.column): (MASKER_OF[c.kind], c.character_class) for c in config.columns}
    report.warnings += [f"masked differently: {x}" for x in same_masker(catalog.foreign_keys, kinds)]
    order = [t for t in FkGraph(catalog.foreign_keys, catalog.tables).order() if t in config.tables()]
    base = f"{folder}/{report.operation_id}"
    marker = f"{base}/configuration"
    if not config.dry_run:
        if sink.exists(spark, marker):
            if spark.read.text(marker).first()[0] != fingerprint(config):
                raise ConfigError("that operation ran with another configuration", operation_id=report.operation_id)
        else:
            spark.createDataFrame([(fingerprint(config),)], "value string").coalesce(1).write.text(marker)

    checks = []
    for table in order:
        step = TableProgress(table)
        report.tables.append(step)
        df, specs = frames[table], specs_of(config, catalog, table)
        try:
            if not catalog.key_of(table):
                step.status = "skipped"
                report.warnings.append(f"{table}: no primary key")
                continue
            step.rows = df.count()
            step.values_masked = step.rows * len(specs)
            if step.rows == 0:
                step.status = "skipped"
                continue
            if config.dry_run:
                step.status = "completed"
                continue
            target = f"{base}/tables/{table}"
            if not sink.is_complete(spark, target):
                entries = mapping.build_mapping(df, table, specs, report.operation_id, key)
                sink.staged_write(entries, f"{base}/mapping/{table}", mode="overwrite")
                sink.staged_write(mapping.row_marks(df, specs, catalog.key_of(table)), f"{base}/marks/{table}", mode="overwrite")
                sink.staged_write(masked(df, specs), target)
            step.status = "completed"
            if config.validate_after:
                names = [s.column for s in specs]
                after = spark.read.parquet(target)
                checks.append(integrity.compared(integrity.snapshot(table, df, names), integrity.snapshot(table, after, names)))
                checks.append(integrity.residual(table, after, names))
        except TABLE_ERRORS as e:
            step.status, step.error = "failed", str(e)
            report.errors.append(f"{table}: {step.error.splitlines()[0][:500]}")
        finally:
            if progress:
                progress(step)
    if checks:
        checks += _orphan_issues(spark, frames, catalog, {t.table: f"{base}/tables/{t.table}" for t in report.tables if t.status == "completed"})
        report.integrity = integrity.Report.of(report.operation_id, reduce(DataFrame.unionByName, checks))
    return report


def _orphan_issues(spark: SparkSession, frames: dict[str, DataFrame], catalog: Catalog, written: dict[str, str]) -> list[DataFrame]:
    """Orphans of the written tables' foreign keys, before and after, as issues."""
    keys = [fk for fk in catalog.foreign_keys if fk.child in frames and fk.parent in frames and (fk.child in written or fk.parent in written)]
    if not keys:
        return []
    now = {t: spark.read.parquet(written[t]) if t in written else df for t, df in frames.items()}
    return [integrity.compared_orphans(integrity.orphan_counts(frames, keys), integrity.orphan_counts(now, keys))]


def restore_tables(spark: SparkSession, folder: str, operation_id: str, catalog: Catalog, key: str, target: str, *, tables: list[str] | None = None, dry: bool = False, strict: bool = True, verify: dict[str, DataFrame] | None = None) -> RunReport:
    """Write the originals of an operation's tables below ``target``, children first.

    A table that cannot be restored is reported and the others go on.  Where
    ``verify`` holds a table as it was before masking, what was written is held
    against it by key; columns that differ are errors of the report's integrity.
    """
    base = f"{folder}/{operation_id}"
    if not sink.exists(spark, f"{base}/mapping"):
        raise MappingError(f"no mapping of {operation_id}", Code.MAPPING_NOT_FOUND)
    key = mapping.load_key(key)
    wanted = {normal_name(t, catalog.schema) for t in tables} if tables else set(catalog.tables)
    report, checks = RunReport(operation_id, dry), []
    for table in FkGraph(catalog.foreign_keys, catalog.tables).restore_order():
        if table not in wanted or not sink.is_complete(spark, f"{base}/tables/{table}"):
            continue
        step = TableProgress(table)
        report.tables.append(step)
        try:
            df, entries = spark.read.parquet(f"{base}/tables/{table}"), spark.read.parquet(f"{base}/mapping/{table}")
            columns = [r["column_name"] for r in entries.select("column_name").distinct().collect()]
            marks = spark.read.parquet(f"{base}/marks/{table}") if sink.exists(spark, f"{base}/marks/{table}") else None  # an earlier version's runs have none
            out = restore.restored(df, entries, columns, key, strict=strict, marks=marks)
            step.rows = df.count()
            step.values_masked = step.rows * len(columns)
            if not dry:
                sink.staged_write(out, f"{target}/{table}", mode="overwrite")
                if verify and table in verify and catalog.key_of(table):
                    differing = restore.differences(verify[table], spark.read.parquet(f"{target}/{table}"), catalog.key_of(table), columns).where("differing > 0")
                    checks.append(differing.select(F.lit("error").alias("severity"), F.lit("RESTORE_DIFFERS").alias("code"), F.lit(table).alias("table_name"), "column_name", F.concat(F.col("differing").cast("string"), F.lit(" rows differ from the original")).alias("message"), F.col("differing").alias("delta")))
            step.status = "completed"
        except TABLE_ERRORS as e:
            step.status, step.error = "failed", str(e)
            report.errors.append(f"{table}: {step.error.splitlines()[0][:500]}")
    if checks:
        report.integrity = integrity.Report.of(operation_id, reduce(DataFrame.unionByName, checks))
    return report
