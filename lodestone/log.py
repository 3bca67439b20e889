"""Loggers with one line format, on standard output."""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def get_logger(name: str) -> logging.Logger:
    """The logger of that name; it gets its handler once, however often it is asked for, and repeats nothing upwards."""
    found = logging.getLogger(name)
    if not any(getattr(h, "_lodestone", False) for h in found.handlers):
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(logging.Formatter(FORMAT))
        out._lodestone = True
        found.addHandler(out)
        found.setLevel(logging.INFO)
        found.propagate = False
    return found
