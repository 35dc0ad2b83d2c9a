"""Log lines as JSON, to standard error or to a file that is rotated by size."""

from __future__ import annotations

import json
import logging
import logging.handlers
import sys
from datetime import UTC, datetime

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class AsJson(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        more = getattr(record, "metadata", {})
        stamp = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return json.dumps({"timestamp": stamp, "level": {"WARNING": "warn"}.get(record.levelname, record.levelname.lower()), "message": record.getMessage(), "event": more.get("event", record.getMessage()), "metadata": more}, default=str)


class Rotated(logging.handlers.RotatingFileHandler):
    """A line that can't be written to the file goes to standard error."""

    def handleError(self, record: logging.LogRecord) -> None:  # noqa: N802
        sys.stderr.write(self.format(record) + "\n")


def logger(name: str = "lodeframe", level: str = "info", file: str | None = None, max_bytes: int = 10 << 20, files: int = 5) -> logging.Logger:
    out = logging.getLogger(name)
    out.setLevel(LEVELS[level])
    out.propagate = False
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    handler = Rotated(file, maxBytes=max_bytes, backupCount=files, delay=True, encoding="utf-8") if file else logging.StreamHandler(sys.stderr)
    handler.setFormatter(AsJson())
    out.addHandler(handler)
    return out
