"""Error kinds of the engine and how Spark's errors map to them."""

from __future__ import annotations

from contextlib import contextmanager


class EngineError(Exception):
    kind, code = "Generic", -1


class InvalidInput(EngineError):
    kind, code = "InvalidInput", -2


class NotSupported(EngineError):
    kind, code = "NotImplemented", -3


class OutOfRange(EngineError):
    kind, code = "OutOfRange", -4


class RuntimeFailure(EngineError):
    kind, code = "RuntimeError", -5


_RANGE = ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_OVERFLOW", "NUMERIC_OUT_OF_SUPPORTED_RANGE", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO")


def translate(error: Exception) -> EngineError:
    """The engine's error for one of Spark's."""
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    if isinstance(error, EngineError):
        return error
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    text = str(error)
    if condition.startswith(_RANGE) or any(f"[{c}" in text for c in _RANGE):
        return OutOfRange(text)
    if condition.startswith(("UNSUPPORTED", "NOT_SUPPORTED")):
        return NotSupported(text)
    if isinstance(error, (ParseException, AnalysisException, ValueError, FileNotFoundError)):
        return InvalidInput(text)
    return RuntimeFailure(text)


@contextmanager
def engine_errors():
    try:
        yield
    except Exception as e:
        raise translate(e) from e
