"""Personal data in free text: detection, redaction, and format checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns, further ones, what replaces their matches, and formats.  Digits and spaces are ASCII's in every engine here.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?:(?:\+?1[-.\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|\+[0-9]{1,3}[-.\s]?[0-9]{1,14}|(?:\+?44[-.\s]?)?(?:\(0\)|0)?[1-9][0-9]{9})",
    "ssn": r"\b(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-?(?:0[1-9]|[1-9][0-9])-?(?:[0-9]{3}[1-9]|[0-9]{2}[1-9][0-9]|[0-9][1-9][0-9]{2}|[1-9][0-9]{3})\b",
    "credit_card": r"\b(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5}|(?:6011|65[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "api_key": r"(?i)(?:(?:api[_-]?key|token|secret|password|pwd)[_-]?[:=\s]+[A-Za-z0-9_\-]{16,}|(?:sk|pk)_(?:test|live)_[A-Za-z0-9]{24,}|AKIA[A-Z0-9]{16}|Bearer\s+[A-Za-z0-9\-._~+/]+=*)",
}
EXTRA_PATTERNS = {
    "drivers_license": r"\b[A-Z]{1,2}[0-9]{5,8}\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "medical_record": r"(?i)\b(?:MRN|Medical[_\s]?Record)[_\s]?(?:Number)?[:\s]+[A-Z0-9]{6,}\b",
}
REPLACEMENTS = {"email": "***@***", "phone": "***-***-****", "ssn": "***-**-****", "credit_card": "****-****-****-****", "iban": "****", "ip_address": "***.***.***.***", "api_key": "***API_KEY***"}
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "email_ip": r"@\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\]$",
    "phone_us": r"(?i)^(?:\+?1[-.\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?:\s*(?:ext|x|#)\.?\s*[0-9]+)?$",
    "phone_international": r"^\+[0-9]{1,3}[-.\s]?[0-9]{1,14}$",
    "ssn": r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])(?:-(?:0[1-9]|[1-9][0-9])-|(?:0[1-9]|[1-9][0-9]))(?:[0-9]{3}[1-9]|[0-9]{2}[1-9][0-9]|[0-9][1-9][0-9]{2}|[1-9][0-9]{3})$",
    "name": "^[A-Za-zÀ-ſ\\s\\-'.]+$",
}
#: What every match of a kind holds, cheaply looked for before its pattern is.
GUARDS = {"email": "@", "phone": r"[0-9]{3}|\+[0-9]", "ssn": "[0-9]{3}", "credit_card": "[0-9]{4}", "iban": "[A-Z]{2}[0-9]{2}", "ip_address": r"[0-9]\.[0-9]"}
#: The kinds that integrity checks look for.
RESIDUAL = ("email", "phone", "ssn", "credit_card")


def active_patterns(*, emails: bool = True, phones: bool = True, ssn: bool = True, credit_cards: bool = True, custom: Mapping[str, str] | None = None) -> dict[str, tuple[str, str]]:
    """Pattern and replacement by kind in the order in which they apply; keys and addresses of machines are always among them.  Custom patterns that do not compile are left out."""
    on = {"email": emails, "phone": phones, "ssn": ssn, "credit_card": credit_cards, "api_key": True, "ip_address": True}
    out = {kind: (PATTERNS[kind], REPLACEMENTS[kind]) for kind, wanted in on.items() if wanted}
    for name, pattern in (custom or {}).items():
        try:
            re.compile(pattern)
        except re.error:
            continue
        out[f"custom_{name}"] = (pattern, f"***{name.upper()}***")
    return out


def redact(text: Column, patterns: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """``text`` with every match replaced, pattern after pattern."""

    def replaced(t: Column, kind: str, pattern: str, replacement: str) -> Column:
        new = F.regexp_replace(t, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
        return F.when(t.rlike(GUARDS[kind]), new).otherwise(t) if pattern == PATTERNS.get(kind) and kind in GUARDS else new

    for kind, (pattern, replacement) in (patterns if patterns is not None else active_patterns()).items():
        # bound once, as the guard and the replacement both read it
        text = F.get(F.transform(F.array(text), lambda t: replaced(t, kind, pattern, replacement)), F.lit(0))  # noqa: B023
    return text


def redact_nested(value: Column, kind: T.DataType, patterns: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """Redaction of every string inside arrays, maps (values) and structs."""
    if isinstance(kind, T.StringType):
        return redact(value, patterns)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType, patterns))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redact_nested(x, kind.valueType, patterns))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redact_nested(value[f.name], f.dataType, patterns).alias(f.name) for f in kind)))
    return value


def has(text: Column, kind: str) -> Column:
    """Whether ``text`` holds personal data of a kind; null does not."""
    found = text.rlike({**PATTERNS, **EXTRA_PATTERNS}[kind])
    return F.coalesce(F.when(text.rlike(GUARDS[kind]), found) if kind in GUARDS else found, F.lit(False))


def found_kinds(text: Column, kinds: Sequence[str] = RESIDUAL, whitelist: Sequence[str] = ()) -> Column:
    """The kinds in ``text``, none if any pattern of ``whitelist`` is found in it, in either case."""
    kept = F.array_compact(F.array(*(F.when(has(text, k), F.lit(k)) for k in kinds)))
    for pattern in whitelist:
        kept = F.when(F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)), F.array().cast("array<string>")).otherwise(kept)
    return kept


def valid_format(value: Column, kind: str) -> Column:
    """Whether ``value`` has the format of a kind: email, phone, ssn or name."""
    if kind == "email":
        ok = value.rlike(FORMATS["email"]) | value.rlike(FORMATS["email_ip"])
    elif kind == "phone":
        n = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
        ok = value.rlike(FORMATS["phone_us"]) | value.rlike(FORMATS["phone_international"]) | n.between(10, 15)
    elif kind == "ssn":
        ok = value.rlike(FORMATS["ssn"])
    elif kind == "name":
        ok = value.rlike(FORMATS["name"]) & value.rlike("[A-Za-zÀ-ſ]") & ~F.contains(value, F.lit("   "))
    else:
        raise ValueError(f"no format for {kind}")
    return F.coalesce(ok, F.lit(False))


def ssn_format(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "formatted").when(value.rlike("^[0-9]{9}$"), "plain").otherwise("unknown")


def examples(df: DataFrame, table: str, columns: Sequence[str], order: str, most: int = 10, whitelist: Sequence[str] = ()) -> DataFrame:
    """Up to ``most`` findings of a table, first by ``order``, then column and kind: table_name, column_name, kind, example (50 characters)."""
    each = df.select(F.col(order).alias("__o"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("__o", "x.*")
    hits = each.select("__o", "column_name", "value", F.explode(found_kinds(F.col("value"), whitelist=whitelist)).alias("kind"))
    return hits.orderBy("__o", "column_name", "kind").limit(most).select(F.lit(table).alias("table_name"), "column_name", "kind", F.left("value", F.lit(50)).alias("example"))


def effectiveness(df: DataFrame, columns: Sequence[str], kinds: Sequence[str] = RESIDUAL) -> DataFrame:
    """Per column the share, in per cent, of values without any pattern; 100 for none."""
    hit = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.when(F.size(found_kinds(F.col(c).cast("string"), kinds)) > 0, 1.0).otherwise(0.0)))
    one = df.agg(*(hit(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (100 * (1 - F.coalesce(F.col(c), F.lit(0.0)))).alias("effectiveness")) for c in columns))).alias("x")).select("x.*")
