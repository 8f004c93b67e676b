"""Settings: defaults, a project file, an external configuration, the environment and explicit options."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    root_id: str = ""
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    aggregate: tuple[str, ...] = ()
    only_rules: tuple[str, ...] = ()
    graph: str = "off"
    subsystem_depth: int = 0
    subsystem_groups: tuple[str, ...] = ()
    primary_languages: int = 5
    primary_threshold: float = 0.05
    extension_rules: bool = False
    omit: tuple[str, ...] = ()
    reclassify: tuple[dict, ...] = ()
    properties: Mapping[str, object] = field(default_factory=dict)


def _typed(name: str, value: object) -> object:
    default = getattr(Settings(), name)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(value) if isinstance(value, list | tuple) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    if isinstance(default, int | float | str):
        return type(default)(value)
    return value


def expand(text: str, environment: Mapping[str, str]) -> str:
    """text with $NAME and ${NAME} replaced; names that are not set become empty."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: environment.get(m[1] or m[2], ""), text)


def read(source: str, environment: Mapping[str, str] = os.environ) -> dict:
    """A configuration from a YAML or JSON file, or from inline JSON."""
    if source.lstrip().startswith("{"):
        return json.loads(expand(source, environment))
    with open(source, encoding="utf-8") as f:
        text = expand(f.read(), environment)
    if source.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def from_environment(environment: Mapping[str, str] = os.environ, prefix: str = "GRANARY_") -> dict:
    return {f.name: environment[prefix + f.name.upper()] for f in fields(Settings) if prefix + f.name.upper() in environment}


def check(values: Mapping[str, object]) -> list[str]:
    """What is wrong with a configuration."""
    known = {f.name for f in fields(Settings)}
    out = [f"unknown setting {k}" for k in values if k not in known]
    if values.get("graph", "off") not in ("off", "direct", "full"):
        out.append("graph is one of off, direct, full")
    out += [f"reclassify {k}: no match, or neither language nor type" for k, r in enumerate(values.get("reclassify") or ()) if not (isinstance(r, Mapping) and r.get("match") and (r.get("language") or r.get("type")))]
    return out


def layered(*layers: Mapping[str, object]) -> Settings:
    """Settings from layers, the weakest first; lists of excludes add up, other values replace."""
    out = Settings()
    for layer in layers:
        values = {k: _typed(k, v) for k, v in layer.items() if k in {f.name for f in fields(Settings)} and v is not None}
        if "exclude" in values:
            values["exclude"] = tuple(dict.fromkeys([*out.exclude, *values["exclude"]]))
        if "properties" in values:
            values["properties"] = {**out.properties, **values["properties"]}
        out = replace(out, **values)
    return out


def common_parent(paths: list[str]) -> tuple[str, list[str]]:
    """The directory above all paths, and the paths below it."""
    base = os.path.commonpath([os.path.abspath(p) for p in paths])
    return base, sorted(os.path.relpath(os.path.abspath(p), base) for p in paths)


def git_info(folder: str) -> dict[str, str]:
    """branch, commit (7 digits) and remote of the repository at exactly this folder; {} if there is none."""
    git = os.path.join(folder, ".git")
    if not os.path.isdir(git):
        return {}

    def text(name: str) -> str:
        try:
            with open(os.path.join(git, name), encoding="utf-8") as f:
                return f.read()
        except OSError:
            return ""

    head = text("HEAD").strip()
    branch = head.removeprefix("ref: refs/heads/") if head.startswith("ref:") else ""
    commit = text(head.removeprefix("ref: ")).strip() if branch else head
    if branch and not commit:
        packed = re.search(rf"(?m)^([0-9a-f]{{40}}) refs/heads/{re.escape(branch)}$", text("packed-refs"))
        commit = packed[1] if packed else ""
    remote = re.search(r'\[remote "origin"\][^\[]*?url\s*=\s*(\S+)', text("config"))
    return {"branch": branch, "commit": commit[:7], "remote_url": re.sub(r"^([a-zA-Z][\w+.-]*://)[^@/]*@", r"\1", remote[1]) if remote else ""}
