"""Which project a folder belongs to."""

from __future__ import annotations

import re
from pathlib import Path


def parse_project(text: str) -> str | None:
    """The value of a top-level `project = "name"` line."""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            return None
        found = re.match(r"""project\s*=\s*(["'])(.*?)\1\s*(#.*)?$""", line)
        if found:
            return found[2] or None
    return None


def detect_project(start: str | Path, config: str = ".quillstone.toml") -> str | None:
    """The project named in the nearest config file upwards, else the name of the nearest folder that holds .git."""
    folders = [Path(start).resolve(), *Path(start).resolve().parents]
    for folder in folders:
        if (folder / config).is_file() and (name := parse_project((folder / config).read_text())):
            return name
    return next((f.name for f in folders if (f / ".git").exists()), None)
