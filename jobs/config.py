"""Config files of the jobs: JSON objects whose keys are the fields of the job's config class."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


def load(kind: type[T], path: str | Path) -> T:
    """The config in the file; a key that the job does not know is an error, one that is missing has its default."""
    found = json.loads(Path(path).read_text())
    unknown = set(found) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**found)
