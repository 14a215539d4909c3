import io
import json
import logging

import pytest

from maskwright import logs
from maskwright.errors import DataValidationError
from maskwright.operators import detection
from maskwright.retries import may_pass, retrying


def test_retries():
    waits, calls = [], []

    class Busy(Exception):
        retryable, retry_after = True, 7

    def flaky(fail):
        calls.append(1)
        if len(calls) <= len(fail):
            raise fail[len(calls) - 1]
        return "done"

    run = retrying(4, 0.5, sleep=waits.append)(flaky)
    assert run([ConnectionError("x"), RuntimeError("Deadlock victim"), Busy()]) == "done" and waits == [0.5, 1.0, 7.0]
    calls.clear()
    with pytest.raises(ValueError):
        run([ValueError("no")])
    assert len(calls) == 1 and not may_pass(ValueError("no")) and may_pass(TimeoutError())
    calls.clear()
    with pytest.raises(ConnectionError):
        run([ConnectionError("x")] * 9)
    assert len(calls) == 4


def test_log_lines(spark):
    out = io.StringIO()
    logs.configure(logging.INFO, logging.StreamHandler(out), most=logging.ERROR)
    log = logs.logger("test")
    with logs.correlation("run1", spark) as own:
        assert own == "run1" == logs.correlation_id() and "run1" in spark.getTags()
        log.info("mail %s", "ann@real.org", extra={"rows": [{"ssn": "123-45-6789"}, 3]})
        log.debug("not shown")
        log.critical("nor this")
        with logs.timed("step", log, table="t"):
            pass
        with pytest.raises(KeyError), logs.timed("bad", log):
            raise KeyError("x")
        try:
            raise ValueError("of bob@real.org")
        except ValueError:
            log.exception("oops")
    assert logs.correlation_id() is None and "run1" not in spark.getTags()
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["message"] for x in lines] == ["mail ***@***", "step done", "bad failed", "oops"]
    assert lines[0]["context"] == {"rows": [{"ssn": "***-**-****"}, 3]} and all(x["correlation_id"] == "run1" for x in lines)
    assert lines[1]["context"]["table"] == "t" and lines[1]["context"]["seconds"] >= 0 and lines[3]["error"] == {"type": "ValueError", "message": "of ***@***"}
    with pytest.raises(ValueError):
        logs.Levels(logging.ERROR, logging.INFO)


def test_detection_by_a_provider(spark):
    columns = spark.createDataFrame([(f"t{i}", c, "NVARCHAR") for i in range(5) for c in ("id", "mail")], "table_name string, column_name string, sql_type string")
    asked = []

    def provider(prompt):
        asked.append(prompt)
        if len(asked) == 1:
            raise ConnectionError("lost")
        tables = json.loads(prompt.splitlines()[-1])
        found = [{"table": t, "column": "mail", "kind": "Email", "confidence": c} for t in tables for c in (0.5, 0.9, 7)] + [{"table": "other", "column": "x", "kind": "email"}, {"table": "t0", "column": "id", "kind": "horoscope"}]
        return "```json\n" + json.dumps({"columns": found}) + "\n```"

    cache = {}
    for _ in range(2):
        rows = detection.detect(spark, columns, provider, most=2, cache=cache, sleep=lambda _: None).collect()
        assert [tuple(r)[:4] for r in rows] == [(f"t{i}", "mail", "email", 1.0) for i in range(5)]
    assert len(asked) == 4 and "part 1 of 3" in asked[0] and len(cache) == 3  # one more for the lost call
    assert detection.detect(spark, columns.limit(0), provider).isEmpty()
    for bad in ("no json", "{}", '{"columns": [{"table": 1}]}'):
        with pytest.raises(DataValidationError):
            detection.answered(bad, {})
