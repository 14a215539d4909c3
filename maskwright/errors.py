"""Errors, each with a code, whether a retry may help, and a suggested action."""

from __future__ import annotations

from enum import Enum


class Code(str, Enum):
    CONFIG_FILE_NOT_FOUND = "CONFIG_FILE_NOT_FOUND"
    CONFIG_INVALID_JSON = "CONFIG_INVALID_JSON"
    CONFIG_INVALID_VALUE = "CONFIG_INVALID_VALUE"
    TABLE_NOT_FOUND = "TABLE_NOT_FOUND"
    COLUMN_NOT_FOUND = "COLUMN_NOT_FOUND"
    PRIMARY_KEY_MISSING = "PRIMARY_KEY_MISSING"
    INVALID_UPDATE_DATA = "INVALID_UPDATE_DATA"
    CIRCULAR_DEPENDENCY = "CIRCULAR_DEPENDENCY"
    MASKING_LENGTH_EXCEEDED = "MASKING_LENGTH_EXCEEDED"
    MASKING_TYPE_MISMATCH = "MASKING_TYPE_MISMATCH"
    MASKING_NULL_CONSTRAINT = "MASKING_NULL_CONSTRAINT"
    MASKER_NOT_FOUND = "MASKER_NOT_FOUND"
    MAPPING_NOT_FOUND = "MAPPING_NOT_FOUND"
    MAPPING_KEY_MISSING = "MAPPING_KEY_MISSING"
    RESTORE_AMBIGUOUS = "RESTORE_AMBIGUOUS"
    RESTORE_INCOMPLETE = "RESTORE_INCOMPLETE"
    STAGING_EXISTS = "STAGING_EXISTS"


class EngineError(Exception):
    """Base of all errors of this library."""

    code: Code = Code.CONFIG_INVALID_VALUE

    def __init__(self, message: str, code: Code | None = None, *, retryable: bool = False, action: str | None = None, **context):
        super().__init__(message)
        self.message, self.code, self.retryable, self.action, self.context = message, code or type(self).code, retryable, action, context

    def __str__(self) -> str:
        more = f" ({', '.join(f'{k}={v}' for k, v in self.context.items())})" if self.context else ""
        return f"[{self.code.value}] {self.message}{more}"

    def to_dict(self) -> dict:
        return {"type": type(self).__name__, "code": self.code.value, "message": self.message, "retryable": self.retryable, "suggested_action": self.action, "context": self.context}


class ConfigError(EngineError):
    code = Code.CONFIG_INVALID_VALUE


class SourceError(EngineError):
    code = Code.TABLE_NOT_FOUND


class UpdateError(EngineError):
    code = Code.INVALID_UPDATE_DATA


class CircularDependencyError(EngineError):
    code = Code.CIRCULAR_DEPENDENCY


class MaskingError(EngineError):
    code = Code.MASKING_LENGTH_EXCEEDED


class MappingError(EngineError):
    code = Code.MAPPING_NOT_FOUND


class RestoreError(EngineError):
    code = Code.RESTORE_INCOMPLETE


class DataValidationError(EngineError):
    code = Code.CONFIG_INVALID_VALUE
