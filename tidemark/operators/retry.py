"""Errors that pass by themselves, and how long to wait for that."""

from __future__ import annotations

import random
import re

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import AnalysisException

#: Longest wait between two attempts, in seconds.
MOST_SECONDS = 60.0
#: Names of Java exceptions, as Spark's messages of failed tasks have them too, that another attempt doesn't mend.
_LASTING = re.compile(r"SQLSyntaxError|SQLIntegrityConstraintViolation|SQLDataException|SQLInvalidAuthorizationSpec|SQLFeatureNotSupported|AccessControlException|FileNotFoundException|FileAlreadyExistsException|AnalysisException")
#: Names of those that it may: lost connections, locks, time-outs, lost executors, disturbed reads and writes.
_PASSING = re.compile(
    r"SQLTransient\w*|SQLRecoverable\w*|SQLNonTransientConnection\w*|SQLTimeoutException|CommunicationsException|CannotAcquireLock\w*|MySQLTransactionRollback\w*"
    r"|ConnectException|SocketException|SocketTimeoutException|NoRouteToHostException|UnknownHostException|EOFException|java\.io\.IOException|TimeoutException|ExecutorLostFailure|FetchFailed\w*"
)
#: Classes of SQLSTATE: connections, transactions that were rolled back.
_STATES = ("08", "40")


def _told(error: BaseException) -> list[str]:
    """What the error and its causes, in Python and in the JVM, say of themselves; a SQLSTATE as `state 40001`."""
    told, java = [str(error), type(error).__name__], getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    try:
        for _ in range(20):
            if java is None:
                break
            java = java.java_exception if isinstance(java, Py4JJavaError) else java
            kind = java.getClass()
            told.append(f"{kind.getName()}: {java.getMessage()}")
            if "getSQLState" in {m.getName() for m in kind.getMethods()}:
                told.append(f"state {java.getSQLState()}")
            java = java.getCause()
    except (Py4JError, Py4JJavaError, AttributeError, TypeError):
        pass  # what has been read so far has to do
    inner = error.__cause__ or error.__context__
    return told + (_told(inner) if inner is not None else [])


def passes(error: BaseException) -> bool:
    """May another attempt succeed? What isn't known to pass is lasting, and a lasting cause anywhere decides."""
    if isinstance(error, AnalysisException):
        return False
    told = _told(error)
    if any(_LASTING.search(t) for t in told):
        return False
    if isinstance(error, ConnectionError | TimeoutError) or any(t.startswith(tuple(f"state {s}" for s in _STATES)) for t in told):
        return True
    return any(_PASSING.search(t) for t in told)


def pause(attempt: int, first: float) -> float:
    """Seconds before another attempt after so many failed ones: doubled each time, less up to half by chance, so tables don't come back all at once."""
    return min(MOST_SECONDS, first * 2 ** (attempt - 1)) * random.uniform(0.5, 1.0)
