"""The rule file: YAML with rules, commands and optional engines."""

from __future__ import annotations

import yaml


def parse(text: str, name: str = "ontology.yml") -> dict:
    """rules, commands, optional_engines; raises ValueError for what can't be a rule file."""
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{name} is malformed: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{name} is empty or malformed")
    for n, rule in enumerate(found.get("rules") or []):
        who = f"rule {rule.get('id')}" if rule.get("id") else f"rule entry {n}"
        problems = {
            "is missing id": not rule.get("id"),
            "'when' must be a non-empty list": not rule.get("when"),
            "'expect_any' must be a non-empty list": not rule.get("expect_any"),
            "'severity' must be 'warn' or 'error'": rule.get("severity") not in ("warn", "error"),
            "'message' must be a string": not rule.get("message"),
        }
        for problem, has in problems.items():
            if has:
                raise ValueError(f"{who}: {problem}")
    return {"rules": found.get("rules") or [], "commands": [c for cs in (found.get("commands") or {}).values() for c in cs], "optional_engines": found.get("optional_engines") or {}}
