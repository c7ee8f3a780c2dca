"""Structured events: one JSON object a line, through the standard logging module."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager

LOGGER = logging.getLogger("quarry")


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"at": round(record.created, 3), "level": record.levelname, "event": record.getMessage(), **getattr(record, "fields", {})}, default=str)


def setup(level: str = "INFO", stream=None) -> logging.Logger:
    """Handles the events once, however often it is called."""
    for h in list(LOGGER.handlers):
        LOGGER.removeHandler(h)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(_Json())
    LOGGER.addHandler(handler)
    LOGGER.setLevel(level)
    LOGGER.propagate = False
    return LOGGER


def event(name: str, level: int = logging.INFO, **fields) -> None:
    LOGGER.log(level, name, extra={"fields": fields})


@contextmanager
def timed(name: str, **fields):
    """An event with its milliseconds, and the code of the error that ended it."""
    began = time.perf_counter()
    try:
        yield
    except Exception as e:
        event(name, logging.ERROR, ms=round(1000 * (time.perf_counter() - began)), error=getattr(e, "code", type(e).__name__), **fields)
        raise
    event(name, ms=round(1000 * (time.perf_counter() - began)), **fields)
