"""What to analyse: targets, entry points, ignore files, and the project registry."""

from __future__ import annotations

import json
import os
import posixpath
import re
import tempfile
import tomllib
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import expand_braces, gitignore_to_glob, glob_to_regex
from graphloom.sources.files import EXTENSIONS, check_entry
from graphloom.sources.rule_files import RuleFile
from graphloom.streaming.polling import CHECK_MINUTES

#: Most files in files mode, longest id and name.
MOST_FILES, MOST_ID, MOST_NAME = 1000, 50, 100
#: Settings that a project may override.
OWN_SETTINGS = ("fetch_changelogs", "include_dev_deps", "registry_only")


def detect_target(paths: list[str]) -> tuple[str, list[str]]:  # L11, D34
    """('package', [root]) for nothing or one directory, ('files', paths) for source files."""
    if not paths or len(paths) == 1 and os.path.isdir(paths[0]):
        return "package", [paths[0] if paths else "."]
    if len(paths) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    for p in paths:
        if p.rsplit(".", 1)[-1] not in EXTENSIONS:
            raise ValueError(f"not a source file: {p}")
    return "files", list(paths)


def manifest_entries(content: str) -> list[str]:  # A8
    """main and module of a package manifest that are valid entries."""
    spec = json.loads(content)
    return [check_entry(spec[k]) for k in ("main", "module") if isinstance(spec.get(k), str)]


def entry_patterns(files: list[RuleFile], framework: str | None = None) -> list[tuple[str, str, int]]:  # H2, J3
    """(name, regular expression, priority) of the entry globs, by priority descending and name; a leading '**/' is anchored at the root."""
    rows = [(name, glob.removeprefix("**/"), priority) for f in files if framework in (None, f.framework) for name, glob, priority in f.entries]
    return [(name, glob_to_regex(g, star_crosses=False), priority) for name, glob, priority in sorted(rows, key=lambda r: (-r[2], r[0])) for g in expand_braces(glob)]


def mark_entries(files: DataFrame, given: list[str], patterns: list[tuple[str, str, int]]) -> DataFrame:  # L12, H4
    """Adds is_entry to rows with a path: the given entries, else whatever an entry pattern matches."""
    if given:
        return files.withColumn("is_entry", F.col("path").isin(*given))
    held = F.lit(False)
    for _, regex, _ in patterns:
        held = held | F.col("path").rlike(regex)
    return files.withColumn("is_entry", held)


def ignore_globs(folder: str, name: str = ".gitignore") -> list[str]:  # A20
    """Globs of the ignore files in a folder and all above it."""
    out, here = [], os.path.abspath(folder)
    while True:
        path = os.path.join(here, name)
        if os.path.isfile(path):
            out += [g for g in map(gitignore_to_glob, Path(path).read_text().splitlines()) if g]
        if os.path.dirname(here) == here:
            return out
        here = os.path.dirname(here)


def workspace_root(folder: str) -> tuple[str, list[str]] | None:  # A15
    """The nearest folder upward that declares workspaces, with its member globs; the pnpm file comes before the manifest."""
    here = os.path.abspath(folder)
    while True:
        pnpm, manifest = os.path.join(here, "pnpm-workspace.yaml"), os.path.join(here, "package.json")
        if os.path.isfile(pnpm):
            import yaml

            return here, list((yaml.safe_load(Path(pnpm).read_text()) or {}).get("packages", []))
        if os.path.isfile(manifest):
            found = json.loads(Path(manifest).read_text()).get("workspaces")
            if found:
                return here, list(found["packages"] if isinstance(found, dict) else found)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def atomic_write(path: str, text: str, mode: int = 0o600) -> None:  # B7, A25
    """Write beside the target, read back, and rename."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w") as f:
            f.write(text)
        if Path(temporary).read_text() != text:
            raise OSError(f"{path}: what was written reads back otherwise")
        os.chmod(temporary, mode)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


@dataclass
class Settings:  # A25
    """What holds for all projects. Names and defaults."""

    check_interval_minutes: int = CHECK_MINUTES
    max_concurrent_checks: int = 5
    enable_notifications: bool = True
    fetch_changelogs: bool = False
    include_dev_deps: bool = True
    registry_only: bool = True


@dataclass
class Project:  # A25, L10
    id: str
    name: str
    path: str
    enabled: bool = True
    members_enabled: list[str] = field(default_factory=list)
    members_disabled: list[str] = field(default_factory=list)
    last_checked: datetime | None = None
    settings: dict[str, bool] = field(default_factory=dict)  # overrides of OWN_SETTINGS

    def __post_init__(self):  # D33
        if not re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?", self.id) or len(self.id) > MOST_ID:
            raise ValueError(f"bad project id: {self.id!r}")
        if not self.name or len(self.name) > MOST_NAME:
            raise ValueError(f"bad project name: {self.name!r}")
        if ".." in posixpath.normpath(self.path).split("/"):
            raise ValueError(f"bad project path: {self.path!r}")
        if not set(self.settings) <= set(OWN_SETTINGS):
            raise ValueError(f"bad project settings: {sorted(self.settings)}")


def _toml(value) -> str:
    """A value as TOML: JSON strings, numbers and lists are TOML too."""
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k} = {_toml(v)}" for k, v in value.items()) + "}"
    return json.dumps(value)


class Projects:  # L10
    """The project registry, a TOML file written atomically for its owner alone."""

    def __init__(self, path: str):
        self.path = path
        self.items: dict[str, Project] = {}
        self.settings = Settings()
        if os.path.isfile(path):
            kept = tomllib.loads(Path(path).read_text())
            self.settings = Settings(**kept.get("settings", {}))
            for p in kept.get("projects", []):
                self.items[p["id"]] = Project(**p)

    def save(self) -> None:
        lines = lambda values: "".join(f"{k} = {_toml(v)}\n" for k, v in values.items() if v is not None)
        text = f'version = "1.0"\n\n[settings]\n{lines(asdict(self.settings))}\n' + "".join(f"[[projects]]\n{lines(asdict(p))}\n" for p in self.items.values())
        atomic_write(self.path, text)

    def add(self, project: Project) -> None:
        if project.id in self.items:
            raise ValueError(f"project exists: {project.id}")
        self.items[project.id] = project

    def remove(self, id_: str) -> None:
        del self.items[id_]

    def enable(self, id_: str, on: bool = True) -> None:
        self.items[id_].enabled = on

    def validate(self) -> list[str]:
        """Ids of projects whose folder is missing."""
        return [p.id for p in self.items.values() if not os.path.isdir(p.path)]

    def checked(self, id_: str, at: datetime) -> None:
        """A check of the project; an earlier one than the last changes nothing."""
        last = self.items[id_].last_checked
        self.items[id_].last_checked = at if last is None else max(last, at)

    def setting(self, id_: str, name: str) -> bool | int:
        """What holds for one project: its own override, else the setting for all."""
        return self.items[id_].settings.get(name, getattr(self.settings, name))

    def watched(self, spark: SparkSession, at: datetime | None = None) -> DataFrame:
        """The registry as rows (project, at, minutes, enabled) for streaming.due_state.due_log: the settings, holding from `at` (now) on, and the last check of each that had one."""
        since = at or datetime.now(UTC)
        rows = [(p.id, since, self.settings.check_interval_minutes, p.enabled) for p in self.items.values()]
        rows += [(p.id, p.last_checked, None, None) for p in self.items.values() if p.last_checked]
        return spark.createDataFrame(rows, "project string, at timestamp, minutes int, enabled boolean")
