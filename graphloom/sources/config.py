"""Analysis configuration, manifest updates on disk, and the registry of language backends."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame

from graphloom.operators.deps import SECTIONS
from graphloom.operators.quality import SMELLS, thresholds
from graphloom.plans.entries import atomic_write


def quality_config(path: str) -> dict[str, int]:  # A26, D31
    """Smell thresholds of a configuration's [quality] table, keyed by smell; defaults where the file or a key is missing. Other tables are accepted and not used."""
    if not os.path.isfile(path):
        return thresholds()
    given = tomllib.loads(Path(path).read_text()).get("quality", {})
    snake = {re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower(): name for name, *_ in SMELLS}
    return thresholds({snake[k]: v for k, v in given.items() if k in snake})


def update_manifest(path: str, wanted: dict[tuple[str, str], str], dry_run: bool = False) -> list[tuple[str, str, str, str]]:  # B6
    """Set requirements of (dependency type, package) in a package manifest: (type, package, old, new) of what changes. Key order stays; the file is replaced atomically."""
    spec = json.loads(Path(path).read_text())
    changed = []
    for section, kind in SECTIONS.items():
        for package, old in spec.get(section, {}).items():
            new = wanted.get((kind, package))
            if new is not None and new != old:
                spec[section][package] = new
                changed.append((kind, package, old, new))
    if changed and not dry_run:
        atomic_write(path, json.dumps(spec, indent=2, ensure_ascii=False) + "\n", mode=os.stat(path).st_mode & 0o777)
    return changed


def update_cargo_manifest(path: str, wanted: dict[tuple[str, str], str], dry_run: bool = False) -> list[tuple[str, str, str, str]]:  # B6
    """The same for a Cargo manifest, on its text, so that layout and comments stay: plain entries and inline tables with a version."""
    from graphloom.sources.lockfiles import CARGO_SECTIONS

    changed, section, out = [], None, []
    for line in Path(path).read_text().splitlines(keepends=True):
        head = re.match(r"\s*\[([^\]]+)\]", line)
        section = head[1].strip() if head else section
        entry = re.match(r"""(\s*"?)([\w-]+)("?\s*=\s*(?:\{.*?\bversion\s*=\s*)?")([^"]*)(".*)""", line, re.S)
        kind = CARGO_SECTIONS.get(section or "")
        new = wanted.get((kind, entry[2])) if entry and kind else None
        if new is not None and new != entry[4]:
            changed.append((kind, entry[2], entry[4], new))
            line = entry[1] + entry[2] + entry[3] + new + entry[5]
        out.append(line)
    if changed and not dry_run:
        atomic_write(path, "".join(out), mode=os.stat(path).st_mode & 0o777)
    return changed


class Backend(Protocol):  # L1
    """A language: its name, extensions, and an analysis of files (path, length, content)."""

    name: str
    extensions: tuple[str, ...]
    analyze: Callable[..., DataFrame]


class Backends:  # L1
    """Backends by extension (the first registered wins) or by name, whatever its case."""

    def __init__(self) -> None:
        self.items: list[Backend] = []

    def register(self, backend: Backend) -> None:
        self.items.append(backend)

    def for_path(self, path: str) -> Backend | None:
        extension = path.rsplit(".", 1)[-1]
        return next((b for b in self.items if extension in b.extensions), None)

    def by_name(self, name: str) -> Backend | None:
        return next((b for b in self.items if b.name.lower() == name.lower()), None)
