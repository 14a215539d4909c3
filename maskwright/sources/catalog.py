"""What is known of a set of tables: columns, keys, constraints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskwright.errors import Code, SourceError


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    sql_type: str
    max_length: int | None = None
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None
    identity: bool = False
    computed: bool = False

    @property
    def unicode(self) -> bool:
        return self.sql_type.upper().startswith("N")

    @property
    def fixed(self) -> bool:
        return self.sql_type.upper() in ("CHAR", "NCHAR")


@dataclass(frozen=True)
class ForeignKey:
    """Columns of ``child`` that name a row of ``parent``, in the order of the parent's key."""

    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def self_referencing(self) -> bool:
        return self.child == self.parent


@dataclass
class Table:
    name: str
    columns: dict[str, ColumnInfo]
    primary_key: tuple[str, ...] = ()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    is_view: bool = False
    update_triggers: tuple[str, ...] = ()


def normal_name(name: str, schema: str = "dbo") -> str:
    """``[s].[t]``, ``s.t`` and ``t`` as ``s.t``."""
    parts = [p.strip("[]") for p in name.split(".")]
    return ".".join(parts if len(parts) > 1 else [schema, *parts])


def sql_type(kind: T.DataType) -> tuple[str, int | None, int | None]:
    """A Spark type as declared type, precision and scale."""
    if isinstance(kind, T.DecimalType):
        return "DECIMAL", kind.precision, kind.scale
    names = {T.StringType: "NVARCHAR", T.LongType: "BIGINT", T.IntegerType: "INT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "FLOAT", T.FloatType: "REAL", T.BooleanType: "BIT", T.DateType: "DATE", T.TimestampType: "DATETIME2", T.TimestampNTZType: "DATETIME2", T.BinaryType: "VARBINARY"}
    return names.get(type(kind), kind.simpleString().upper()), None, None


class Catalog:
    """Tables by normalised name, and the foreign keys between them."""

    def __init__(self, tables: Iterable[Table] = (), foreign_keys: Iterable[ForeignKey] = (), schema: str = "dbo"):
        self.schema = schema
        self.tables = {normal_name(t.name, schema): t for t in tables}
        self.foreign_keys = list(foreign_keys)

    @classmethod
    def of(cls, frames: dict[str, DataFrame], keys: dict[str, Sequence[str]] | None = None, foreign_keys: Iterable[ForeignKey] = (), declared: dict[str, dict[str, ColumnInfo]] | None = None, schema: str = "dbo") -> Catalog:
        """From DataFrames' schemas.  A field's metadata may hold sqlType and maxLength; ``declared`` overrides."""
        tables = []
        for name, df in frames.items():
            columns = {}
            for f in df.schema:
                kind, precision, scale = sql_type(f.dataType)
                columns[f.name] = ColumnInfo(f.name, f.metadata.get("sqlType", kind), f.metadata.get("maxLength"), f.nullable, precision, scale)
            columns |= (declared or {}).get(name, {})
            tables.append(Table(normal_name(name, schema), columns, tuple((keys or {}).get(name, ()))))
        return cls(tables, foreign_keys, schema)

    @classmethod
    def of_session(cls, spark: SparkSession, database: str, keys: dict[str, Sequence[str]] | None = None, foreign_keys: Iterable[ForeignKey] = ()) -> Catalog:
        """From the tables of a database of the session's catalog, views included."""
        listed = spark.catalog.listTables(database)
        if not listed:
            raise SourceError(f"no tables in {database}", Code.TABLE_NOT_FOUND)
        out = cls.of({f"{database}.{t.name}": spark.table(f"{database}.{t.name}") for t in listed if not t.isTemporary}, keys, foreign_keys, schema=database)
        for t in listed:
            if not t.isTemporary:
                out.table(f"{database}.{t.name}").is_view = t.tableType == "VIEW"
        return out

    def table(self, name: str) -> Table:
        found = self.tables.get(normal_name(name, self.schema))
        if found is None:
            raise SourceError(f"no table {name}", Code.TABLE_NOT_FOUND)
        return found

    def require_columns(self, name: str, columns: Sequence[str]) -> None:
        missing = [c for c in columns if c not in self.table(name).columns]
        if missing:
            raise SourceError(f"{name} has no column {', '.join(missing)}", Code.COLUMN_NOT_FOUND, table=name)

    def key_of(self, name: str) -> tuple[str, ...]:
        return self.table(name).primary_key

    def warnings(self) -> list[str]:
        """Tables without columns or key, keys of columns that are not there, foreign keys of tables that are not there."""
        out = []
        for name, t in sorted(self.tables.items()):
            if not t.columns:
                out.append(f"{name}: no columns")
            if not t.primary_key:
                out.append(f"{name}: no primary key")
            out += [f"{name}: key column {c} is missing" for c in t.primary_key if c not in t.columns]
        for fk in self.foreign_keys:
            out += [f"{fk.name}: {side} table {n} is missing" for side, n in (("child", fk.child), ("parent", fk.parent)) if normal_name(n, self.schema) not in self.tables]
        return out

    def foreign_key_columns(self, pii: Iterable[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
        """Of the (table, column) pairs of ``pii`` those in a foreign key: table, column, side, constraint."""
        out = []
        for table, column in pii:
            name = normal_name(table, self.schema)
            for fk in self.foreign_keys:
                if name == normal_name(fk.child, self.schema) and column in fk.child_columns:
                    out.append((name, column, "child", fk.name))
                if name == normal_name(fk.parent, self.schema) and column in fk.parent_columns:
                    out.append((name, column, "parent", fk.name))
        return out

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, c.name, c.sql_type.upper(), c.max_length, c.nullable, c.name in t.primary_key) for n, t in sorted(self.tables.items()) for c in t.columns.values()]
        return spark.createDataFrame(rows, "table_name string, column_name string, sql_type string, max_length int, is_nullable boolean, in_key boolean")
