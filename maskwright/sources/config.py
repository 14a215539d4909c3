"""Configuration: which columns are masked and how, from JSON and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from maskwright.errors import Code, ConfigError
from maskwright.sources.catalog import normal_name

KINDS = ("email", "phone", "name", "ssn", "generic", "address")
#: Kinds that detection may propose, and the masker for each.
MASKER_OF = {**{k: k for k in KINDS}, "credit_card": "generic", "date_of_birth": "generic", "ip_address": "generic", "account_number": "generic"}
PREFIX = "SANITIZATION_"
#: Never read from the environment into the configuration, and never shown.
SECRETS = ("password", "encryption_key", "api_key", "token")


@dataclass(frozen=True)
class PiiColumn:
    schema: str
    table: str
    column: str
    kind: str
    nullable: bool = True
    character_class: str = "alphanumeric"
    confidence: float = 1.0
    reason: str = ""

    def __post_init__(self):
        object.__setattr__(self, "kind", self.kind.strip().lower())
        if self.kind not in MASKER_OF:
            raise ConfigError(f"no such kind: {self.kind}", column=self.column)
        if not 0 <= self.confidence <= 1:
            raise ConfigError("confidence lies between 0 and 1", column=self.column)

    @property
    def key(self) -> tuple[str, str, str]:
        return self.schema, self.table, self.column

    @property
    def qualified_table(self) -> str:
        return normal_name(f"{self.schema}.{self.table}")


@dataclass(frozen=True)
class Config:
    columns: tuple[PiiColumn, ...]
    seed: int = 42
    batch_size: int = 10_000
    dry_run: bool = False
    validate_before: bool = True
    validate_after: bool = True
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        keys = [c.key for c in self.columns]
        twice = sorted({k for k in keys if keys.count(k) > 1})
        if twice:
            raise ConfigError(f"configured twice: {', '.join('.'.join(k) for k in twice)}")
        if not 100 <= self.batch_size <= 1_000_000:
            raise ConfigError("batch_size lies between 100 and 1000000")

    def columns_of(self, table: str) -> list[PiiColumn]:
        return [c for c in self.columns if c.qualified_table == normal_name(table)]

    def tables(self) -> list[str]:
        return sorted({c.qualified_table for c in self.columns})


def coerce(text: str):
    """true, false, yes and no as booleans, then numbers, else the text."""
    low = text.strip().lower()
    if low in ("true", "yes"):
        return True
    if low in ("false", "no"):
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_environment(env: Mapping[str, str] | None = None) -> dict:
    """``SANITIZATION_SECTION_KEY`` as {section: {key: value}}; secrets stay out."""
    out: dict[str, dict] = {}
    for name, value in (os.environ if env is None else env).items():
        section, _, key = name.removeprefix(PREFIX).lower().partition("_")
        if name.startswith(PREFIX) and key and not any(s in key for s in SECRETS):
            out.setdefault(section, {})[key] = coerce(value)
    return out


def merged(base: Mapping, over: Mapping) -> dict:
    """``over`` on ``base``, sections key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = {**out[k], **v} if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def parse(data: Mapping) -> Config:
    try:
        columns = tuple(
            PiiColumn(c.get("schema", "dbo"), c["table"], c["column"], c["pii_type"], c.get("nullable", True), (c.get("custom_format") or {}).get("character_class", "alphanumeric"))
            for c in data["pii_columns"]
        )
    except KeyError as e:
        raise ConfigError(f"{e.args[0]} is missing") from e
    database = data.get("database", {})
    return Config(columns, data.get("seed", 42), database.get("batch_size", 10_000), data.get("dry_run", False), data.get("validate_before", True), data.get("validate_after", True), {k: v for k, v in data.items() if k not in ("pii_columns", "seed", "dry_run", "validate_before", "validate_after")})


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"no file {path}", Code.CONFIG_FILE_NOT_FOUND) from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path} is no JSON: {e}", Code.CONFIG_INVALID_JSON) from e
    return parse(merged(data, from_environment(env)))


def save(config: Config, path: str | Path) -> None:
    """As JSON that :func:`load` reads; what may be secret is written as null."""
    data = {
        "seed": config.seed, "dry_run": config.dry_run, "validate_before": config.validate_before, "validate_after": config.validate_after,
        **{k: {a: None if any(s in a for s in SECRETS) else b for a, b in v.items()} if isinstance(v, dict) else v for k, v in config.options.items()},
        "pii_columns": [{"schema": c.schema, "table": c.table, "column": c.column, "pii_type": c.kind, "nullable": c.nullable, "custom_format": {"character_class": c.character_class}} for c in config.columns],
    }
    Path(path).write_text(json.dumps(data, indent=2), encoding="utf-8")


def apply_edits(columns: list[PiiColumn], edits: list[tuple]) -> list[PiiColumn]:
    """A review: ("add", column), ("remove", key), ("modify", key, changes) and ("undo",), in order; adding what is there changes nothing."""
    states = [list(columns)]
    for op, *args in edits:
        now = list(states[-1])
        if op == "undo":
            if len(states) > 1:
                states.pop()
            continue
        if op == "add":
            if all(c.key != args[0].key for c in now):
                now.append(args[0])
        elif op == "remove":
            now = [c for c in now if c.key != tuple(args[0])]
        elif op == "modify":
            now = [replace(c, **args[1]) if c.key == tuple(args[0]) else c for c in now]
        else:
            raise ConfigError(f"no such edit: {op}")
        states.append(now)
    return states[-1]


def merge_existing(found: list[PiiColumn], existing: list[PiiColumn]) -> list[PiiColumn]:
    """Found columns once each, the first of equal keys, then the existing ones that are not among them."""
    out = {c.key: c for c in reversed([*found, *existing])}
    return [out[k] for k in dict.fromkeys(c.key for c in [*found, *existing])]


def show(column: PiiColumn) -> dict:
    return asdict(column)
