"""Step tables of the study: written once per session and folder, read by every later step."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame

from pulsegrid.session import durable

_WRITTEN: dict[tuple[str, str, str], object] = {}


def stage(plan):
    """The tables a step returns are checkpointed, and later steps of the same run read them."""

    @wraps(plan)
    def once(t):
        key = (t.spark.sparkContext.applicationId, t.folder, f"{plan.__module__}.{plan.__name__}")
        if key not in _WRITTEN:
            _WRITTEN[key] = _write(plan(t))
        return _WRITTEN[key]

    return once


def _write(result):
    if isinstance(result, DataFrame):
        return durable(result)
    if isinstance(result, dict):
        return {k: _write(v) for k, v in result.items()}
    return tuple(_write(v) for v in result)


def forget() -> None:
    """Start the next run from the source tables."""
    _WRITTEN.clear()
