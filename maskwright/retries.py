"""Calls that are tried again.

Spark tries its own tasks again (``spark.task.maxFailures``); this is for calls
that the driver makes: opening a database, asking a service.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

#: What a message says where waiting helps: lost connections, deadlocks, a service that is busy.
PASSING = ("deadlock", "timed out", "timeout", "connection reset", "connection refused", "too many requests", "temporarily unavailable")


def may_pass(error: Exception) -> bool:
    """Whether ``error`` says of itself, or by its message, that another try may help."""
    told = getattr(error, "retryable", None)
    return told if told is not None else isinstance(error, (ConnectionError, TimeoutError)) or any(w in str(error).lower() for w in PASSING)


def retrying(attempts: int = 3, wait: float = 0.5, factor: float = 2.0, when: Callable[[Exception], bool] = may_pass, sleep: Callable[[float], None] = time.sleep):
    """A decorator: up to ``attempts`` calls, ``wait`` seconds before the second and ``factor`` times as long before each further one.

    An error that carries ``retry_after`` in seconds sets the next wait.  What
    ``when`` does not accept is raised at once, and the last error as it is.
    """

    def around(call):
        @wraps(call)
        def run(*args, **kwargs):
            pause = wait
            for left in reversed(range(attempts)):
                try:
                    return call(*args, **kwargs)
                except Exception as error:
                    if not left or not when(error):
                        raise
                    sleep(float(getattr(error, "retry_after", None) or pause))
                    pause *= factor

        return run

    return around
