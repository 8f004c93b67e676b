"""Listings of what the engine knows, as text, JSON or YAML."""

from __future__ import annotations

import json
from collections.abc import Sequence

from ..sources import files, rules


def techs(rule_set: Sequence[dict] = rules.STARTER) -> list[dict]:
    return sorted(({"tech": r["tech"], "name": r.get("name", r["tech"]), "category": r["type"]} for r in rule_set), key=lambda r: r["tech"])


def categories(rule_set: Sequence[dict] = rules.STARTER) -> list[dict]:
    """Categories with the number of their technologies, the largest first."""
    known = {c: {"is_component": a, "is_primary_tech": b, "create_edges": e} for c, a, b, e in rules.CATEGORIES}
    count: dict[str, int] = {}
    for r in rule_set:
        count[r["type"]] = count.get(r["type"], 0) + 1
    return [{"category": c, "techs": count.get(c, 0)} | known.get(c, {}) for c in sorted({*known, *count}, key=lambda c: (-count.get(c, 0), c))]


def ecosystems(found: Sequence[dict] = rules.ECOSYSTEMS) -> list[dict]:
    return sorted(found, key=lambda e: e["name"])


def languages() -> list[dict]:
    out: dict[str, dict] = {}
    for key, (name, kind) in files.LANGUAGES.items():
        out.setdefault(name, {"language": name, "type": kind, "extensions": [], "files": []})["extensions" if key.startswith(".") else "files"].append(key)
    return sorted(out.values(), key=lambda x: x["language"])


def rule(tech: str, rule_set: Sequence[dict] = rules.STARTER) -> list[dict]:
    return [r for r in rule_set if r["tech"] == tech]


LISTINGS = {"techs": techs, "categories": categories, "ecosystems": ecosystems, "languages": languages}


def show(rows: Sequence[dict], form: str = "text") -> str:
    if form == "json":
        return json.dumps(list(rows), ensure_ascii=False, indent=2)
    if form == "yaml":
        import yaml

        return yaml.safe_dump([dict(r) for r in rows], allow_unicode=True, sort_keys=False)
    return "\n".join("  ".join(", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r.values()) for r in rows)
