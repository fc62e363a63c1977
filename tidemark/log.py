"""Logging to standard output and, if asked for, a file."""

from __future__ import annotations

import logging
import sys

#: The formats of log lines and their times.
FORMAT, DATES = "%(asctime)s [%(levelname)s] %(name)s: %(message)s", "%Y-%m-%d %H:%M:%S"


def set_up(level: int = logging.INFO, log_file: str | None = None) -> logging.Logger:
    """Configure the root logger anew: a second call replaces what the first one set."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if log_file:
        handlers.append(logging.FileHandler(log_file, encoding="utf-8"))
    logging.basicConfig(level=level, format=FORMAT, datefmt=DATES, handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return logging.getLogger()
