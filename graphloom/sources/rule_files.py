"""Rule files: TOML text to rules, detection rules and entry patterns; built-in ones, then those of user and project."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from functools import cache
from importlib.resources import files as resources

from graphloom.operators.rules import MOST_DEPTH, MOST_FILE, Rule


@dataclass(frozen=True)
class Detection:
    framework: str
    priority: int
    type: str
    pattern: str
    weight: float


@dataclass(frozen=True)
class RuleFile:
    framework: str
    priority: int
    suppresses: tuple[str, ...]
    detections: tuple[Detection, ...]
    rules: tuple[Rule, ...]
    entries: tuple[tuple[str, str, int], ...]  # name, glob, priority


def _depth(x) -> int:
    return 1 + max((_depth(v) for v in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 0


def read_rules(text: str) -> RuleFile:  # A17
    if len(text.encode()) > MOST_FILE:
        raise ValueError("rule file too large")
    spec = tomllib.loads(text)
    if _depth(spec) > MOST_DEPTH:
        raise ValueError("rule file nested too deeply")
    head = spec.get("framework", {})
    name, priority = head.get("name", "custom"), head.get("priority", 50)
    detections = tuple(Detection(name, priority, d["type"], d["pattern"], float(d.get("weight", 1.0))) for d in head.get("detection", []))
    rules = tuple(Rule(r["name"], r.get("match", {}), r.get("priority", 0), r.get("action", {"mark_used": True}), r.get("reason") or r.get("description") or "") for r in spec.get("rules", []))
    entries = tuple((e["name"], p, e.get("priority", 0)) for e in spec.get("entry_points", []) for p in e["patterns"])
    return RuleFile(name, priority, tuple(head.get("suppresses", ())), detections, rules, entries)


def by_precedence(*levels: list[Rule]) -> list[Rule]:  # A18, H2
    """Built-in, user and project rules in one list: priority descending, then name."""
    return sorted((r for level in levels for r in level), key=lambda r: (-(r.priority or 0), r.name))


#: The built-in rule files, in the folder rules.
BUILTIN = ("react", "nextjs", "vue", "svelte")


@cache
def _builtin() -> tuple[RuleFile, ...]:
    folder = resources("graphloom.sources") / "rules"
    return tuple(read_rules((folder / f"{x}.toml").read_text(encoding="utf-8")) for x in BUILTIN)


def builtin() -> list[RuleFile]:  # A19
    return list(_builtin())
