"""Settings of a run: nested values with overrides from environment variables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

#: Settings that are lists, given with commas.
LISTS = ("fields", "countries_preferred", "exclude_fields", "target_degrees")


def typed(name: str, text: str) -> Any:
    """The value that a variable's text stands for: true or false, nothing, a list, a whole or other number, else the text."""
    word = text.strip().lower()
    if word in ("true", "false", "null", "none"):
        return {"true": True, "false": False}.get(word)
    if name in LISTS:
        return [item for item in map(str.strip, text.split(",")) if item]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def overridden(settings: Mapping[str, Any], env: Mapping[str, str], prefix: str = "GLEANERY") -> dict[str, Any]:
    """`settings` with the variables PREFIX__A__B (two names or more, in any case) set at a.b; the argument stays as it is."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in settings.items()}
    for variable, text in sorted(env.items()):
        head, *names = variable.split("__")
        if head != prefix or len(names) < 2:
            continue
        *way, last = map(str.lower, names)
        below = overridden_at(out, way)
        below[last] = typed(last, text)
    return out


def overridden_at(tree: dict[str, Any], way: list[str]) -> dict[str, Any]:
    """The mapping at `way`, each step copied so that nothing shared changes, and made where there is none."""
    for name in way:
        inner = tree.get(name)
        tree[name] = dict(inner) if isinstance(inner, Mapping) else {}
        tree = tree[name]
    return tree
