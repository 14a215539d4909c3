"""Checks of a configuration against the catalog, and guesses which columns hold personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.maskers import LEAST
from maskwright.sources.catalog import Catalog, normal_name
from maskwright.sources.config import MASKER_OF, Config

_TEXT = frozenset({"VARCHAR", "NVARCHAR", "CHAR", "NCHAR"})
_LONG = frozenset({"VARCHAR", "NVARCHAR", "TEXT", "NTEXT"})
# Which declared types a kind fits.
FITS = {
    "email": _TEXT | _LONG,
    "phone": _TEXT,
    "name": _LONG,
    "ssn": _TEXT,
    "generic": _TEXT | _LONG,
    "address": _LONG,
    "credit_card": _TEXT,
    "date_of_birth": frozenset({"DATE", "DATETIME", "DATETIME2", "SMALLDATETIME", "VARCHAR", "NVARCHAR"}),
    "ip_address": _TEXT,
    "account_number": _TEXT | {"BIGINT", "INT"},
}
# Lengths that whole values of a kind need.
WHOLE = {"email": 7, "phone": 10, "ssn": 11, "credit_card": 13, "ip_address": 7, "name": 2}
SYSTEM = ("sys", "INFORMATION_SCHEMA", "guest", "db_owner", "db_accessadmin")

ISSUE = "severity string, code string, table_name string, column_name string, message string"


def issues(config: Config, catalog: Catalog) -> list[tuple[str, str, str, str, str]]:
    """What is wrong or noteworthy, column by column in the configuration's order."""
    out: list[tuple[str, str, str, str, str]] = []
    for c in config.columns:
        table = c.qualified_table

        def say(severity: str, code: str, message: str, c=c, table=table) -> None:
            out.append((severity, code, table, c.column, message))

        if c.schema in SYSTEM:
            say("warning", "SYSTEM_SCHEMA", "a schema of the system")
        if c.table.startswith("#"):
            say("error", "TEMPORARY_TABLE", "a temporary table")
            continue
        found = catalog.tables.get(normal_name(table, catalog.schema))
        if found is None:
            say("error", "TABLE_NOT_FOUND", "no such table")
            continue
        if found.is_view:
            say("warning", "VIEW", "a view, not a table")
        info = found.columns.get(c.column)
        if info is None:
            say("error", "COLUMN_NOT_FOUND", "no such column")
            continue
        kind = info.sql_type.upper()
        if kind not in FITS[c.kind]:
            say("error", "INCOMPATIBLE_TYPE", f"{kind} does not fit {c.kind}")
        if info.max_length == -1:
            say("info", "MAX_LENGTH", "of unlimited length")
        elif info.max_length is not None and info.max_length < LEAST.get(MASKER_OF[c.kind], 1):
            say("error", "TOO_SHORT", f"{info.max_length} characters cannot hold a masked {c.kind}")
        elif info.max_length is not None and info.max_length < WHOLE.get(c.kind, 0):
            say("warning", "SHORT", f"{info.max_length} characters are short for {c.kind}")
        if info.fixed:
            say("warning", "FIXED_LENGTH", "masked values are padded")
        if c.nullable and not info.nullable:
            say("error", "NULLABLE_MISMATCH", "configured as nullable, declared as not")
        elif not c.nullable and info.nullable:
            say("warning", "NULLABLE_MISMATCH", "configured as not nullable, declared as nullable")
        if info.identity:
            say("error", "IDENTITY_COLUMN", "an identity column cannot be written")
        if info.computed:
            say("warning", "COMPUTED_COLUMN", "a computed column is skipped")
        keys = [fk for fk in catalog.foreign_keys if normal_name(fk.parent, catalog.schema) == table and c.column in fk.parent_columns]
        if c.column in found.primary_key:
            say("warning", "PRIMARY_KEY", "in a key that other tables refer to" if keys else "in the primary key")
            if len(found.primary_key) > 1:
                say("info", "COMPOSITE_KEY", "one of several key columns")
        for fk in catalog.foreign_keys:
            if normal_name(fk.child, catalog.schema) == table and c.column in fk.child_columns:
                say("warning", "SELF_REFERENCE" if fk.self_referencing else "FOREIGN_KEY", f"refers to {fk.parent}")
        if keys:
            say("warning", "REFERRED_TO", f"referred to by {', '.join(sorted({fk.child for fk in keys}))}")
    return out


def issues_frame(spark: SparkSession, config: Config, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(issues(config, catalog), ISSUE)


# What names of columns tell, in the order in which it is tried.
NOT_PERSONAL = r"(?i)(^|_)(type|template|status|flag)_?id$|(?i)[a-z](Type|Template)ID$|(?i)(^|_)(created|modified|updated)(_?(by|at|date|on))?$|(?i)_?(time|timestamp|flag)$"
NAMES = (
    ("email", r"(?i)e_?mail"),
    ("phone", r"(?i)(phone|mobile|fax)"),
    ("ssn", r"(?i)(^|_)(ssn|social_?security.*|national_?id|tax_?id)(_|$)"),
    ("credit_card", r"(?i)(credit_?card|card_?(number|no)|^cc_?number)"),
    ("date_of_birth", r"(?i)(date_?of_?birth|birth_?date|^dob$|_dob$)"),
    ("address", r"(?i)(address|street|(^|_)city$|zip|postal)"),
    ("name", r"(?i)(first|last|full|patient|middle|maiden|given|family)_?name|(^|_)name$"),
)


def kind_by_name(column: Column) -> Column:
    """The kind that a column's name suggests, or null.  Keys' names (ending in ID or key) suggest none but national and tax ids."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(NAMES):
        found = F.when(column.rlike(pattern), kind).otherwise(found)
    key = column.rlike(r"(?i)(id|key)$") & ~column.rlike(dict(NAMES)["ssn"])
    return F.when(column.rlike(NOT_PERSONAL) | key, None).otherwise(found)


def detected(columns: DataFrame) -> DataFrame:
    """``columns(table_name, column_name, ...)`` that seem personal: table_name, column_name, kind, confidence, reason; the first of equal names."""
    kind = kind_by_name(F.col("column_name"))
    some = columns.select("table_name", "column_name", kind.alias("kind")).where("kind is not null").distinct()
    return some.select("table_name", "column_name", "kind", F.lit(0.9).alias("confidence"), F.concat(F.lit("the name suggests "), F.col("kind")).alias("reason"))
