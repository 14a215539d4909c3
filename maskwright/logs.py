"""The driver's log: one line of JSON a record, personal data redacted, jobs told apart by a correlation id."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from maskwright.functions.patterns import active_patterns

NAME = "maskwright"
_correlation: ContextVar[str | None] = ContextVar("correlation", default=None)
#: What a record of the standard library has anyway; all else was given by the caller.
_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


def correlation_id() -> str | None:
    return _correlation.get()


@contextmanager
def correlation(name: str | None = None, spark: SparkSession | None = None) -> Iterator[str]:
    """Within it every record carries one id, and the jobs of ``spark`` a tag of that name, by which they can be found or cancelled."""
    own = name or uuid.uuid4().hex
    token = _correlation.set(own)
    if spark:
        spark.addTag(own)
    try:
        yield own
    finally:
        if spark:
            spark.removeTag(own)
        _correlation.reset(token)


def redacted(value, patterns: dict[str, tuple[str, str]] | None = None):
    """``value`` without personal data: strings, and those inside dictionaries, lists and tuples."""
    patterns = patterns if patterns is not None else active_patterns()
    if isinstance(value, str):
        for pattern, replacement in patterns.values():
            value = re.sub(pattern, lambda _, r=replacement: r, value)
        return value
    if isinstance(value, dict):
        return {k: redacted(v, patterns) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(redacted(v, patterns) for v in value)
    return value


class Redaction(logging.Filter):
    """Takes personal data out of a record's message and of what the caller added; lets every record pass."""

    def __init__(self, **which):
        super().__init__()
        self.patterns = active_patterns(**which)

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redacted(record.getMessage(), self.patterns), ()
        for k in set(vars(record)) - _PLAIN:
            setattr(record, k, redacted(getattr(record, k), self.patterns))
        return True


class Levels(logging.Filter):
    """Lets records between two levels pass, both included."""

    def __init__(self, least: int = logging.NOTSET, most: int = logging.CRITICAL):
        super().__init__()
        if least > most:
            raise ValueError("the least level is above the greatest")
        self.least, self.most = least, most

    def filter(self, record: logging.LogRecord) -> bool:
        return self.least <= record.levelno <= self.most


class JsonLines(logging.Formatter):
    """A record as one line of JSON: time in UTC, level, logger, message, correlation id, what the caller added, and the error."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if correlation_id():
            line["correlation_id"] = correlation_id()
        more = {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if more:
            line["context"] = more
        if record.exc_info and record.exc_info[0]:
            line["error"] = {"type": record.exc_info[0].__name__, "message": redacted(str(record.exc_info[1]))}
        return json.dumps(line, default=str, ensure_ascii=False)


def logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)


def configure(level: int = logging.INFO, handler: logging.Handler | None = None, *, most: int = logging.CRITICAL, **which) -> logging.Handler:
    """Send this library's records to ``handler``, stderr by default, as JSON without personal data; replaces an earlier one."""
    handler = handler or logging.StreamHandler()
    handler.setFormatter(JsonLines())
    handler.filters = [Levels(level, most), Redaction(**which)]
    root = logger()
    root.handlers, root.propagate = [handler], False
    root.setLevel(level)
    return handler


@contextmanager
def timed(what: str, log: logging.Logger | None = None, **context) -> Iterator[None]:
    """Logs how long its block took, and whether it failed."""
    log, began = log or logger(), time.perf_counter()
    took = lambda: round(time.perf_counter() - began, 3)
    try:
        yield
    except BaseException:
        log.error("%s failed", what, extra={"seconds": took(), **context})
        raise
    log.info("%s done", what, extra={"seconds": took(), **context})
