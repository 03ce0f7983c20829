"""Log lines as text or JSON."""

from __future__ import annotations

import json
import logging
import sys


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        fields = {"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()}
        return json.dumps(fields | getattr(record, "fields", {}), default=str)


class _Text(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        rest = "".join(f" {k}={v}" for k, v in getattr(record, "fields", {}).items())
        return f"{self.formatTime(record)} {record.levelname} {record.getMessage()}{rest}"


def logger(debug: bool = False, form: str = "json", stream=None) -> logging.Logger:
    """A logger of its own that writes ``form`` ("json" or "text"), with debug lines if asked."""
    out = logging.Logger("rangeparts", logging.DEBUG if debug else logging.INFO)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(_Text() if form == "text" else _Json())
    out.addHandler(handler)
    return out


def say(log: logging.Logger, level: int, message: str, **fields) -> None:
    log.log(level, message, extra={"fields": fields})
