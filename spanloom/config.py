"""Nested settings: defaults, overlaid by a YAML or JSON file or a named profile, read by dotted path."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

#: Settings that hold where a file says nothing.
DEFAULTS: dict[str, Any] = {
    "vad": {"threshold": 0.5, "min_speech_duration_ms": 250, "min_silence_duration_ms": 400},
    "merging": {"min_silence_gap": 0.4, "max_segment_length": 20.0, "padding": 0.1, "min_segment_length": 0.5},
    "subtitle": {"min_duration": 0.8, "max_duration": 5.0, "max_chars_cjk": 20, "max_chars_latin": 42, "gap_handling": {"seamless_threshold": 0.2, "natural_pause_max": 1.0}},
}


def overlay(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; mappings meet key by key, anything else replaces."""
    out = dict(base)
    for key, value in over.items():
        held = out.get(key)
        out[key] = overlay(held, value) if isinstance(held, Mapping) and isinstance(value, Mapping) else value
    return out


def parse(text: str, suffix: str) -> dict[str, Any]:
    """A settings document; an empty one is empty, and one that is not a mapping is an error."""
    if suffix == ".json":
        found = json.loads(text) if text.strip() else {}
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml module; JSON files work without it") from e
        found = yaml.safe_load(text) or {}
    if not isinstance(found, Mapping):
        raise ValueError("settings must be a mapping")
    return dict(found)


class Settings:
    """Immutable nested settings; ``settings["vad.threshold"]`` reads by path."""

    def __init__(self, values: Mapping[str, Any], defaults: Mapping[str, Any] = DEFAULTS):
        self.values = overlay(defaults, values)

    @classmethod
    def load(cls, path: str | Path, defaults: Mapping[str, Any] = DEFAULTS) -> Settings:
        """A file's settings; those under a ``pipeline`` key count as top-level ones."""
        path = Path(path)
        found = parse(path.read_text(encoding="utf-8"), path.suffix.lower())
        inner = found.pop("pipeline", None)
        return cls(overlay(found, inner) if isinstance(inner, Mapping) else found, defaults)

    @classmethod
    def profile(cls, folder: str | Path, name: str = "default") -> Settings:
        """The settings of ``name`` in ``folder`` (.yaml, .yml or .json)."""
        for suffix in (".yaml", ".yml", ".json"):
            if (path := Path(folder) / f"{name}{suffix}").is_file():
                return cls.load(path)
        raise FileNotFoundError(f"no profile {name!r} in {folder}")

    @staticmethod
    def profiles(folder: str | Path) -> list[str]:
        return sorted({p.stem for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml", ".json")})

    def __getitem__(self, path: str) -> Any:
        at: Any = self.values
        for key in path.split("."):
            if not isinstance(at, Mapping) or key not in at:
                raise KeyError(path)
            at = at[key]
        return at

    def get(self, path: str, default: Any = None) -> Any:
        try:
            return self[path]
        except KeyError:
            return default

    def with_(self, **paths: Any) -> Settings:
        """A copy with values set by path, dots written as two underscores."""
        over: dict[str, Any] = {}
        for path, value in paths.items():
            *heads, last = path.split("__")
            at = over
            for key in heads:
                at = at.setdefault(key, {})
            at[last] = value
        return Settings(over, self.values)

    def rows(self) -> Iterator[tuple[str, str]]:
        """(path, JSON value) of every leaf, for a table of profile versions."""

        def walk(head: str, value: Any) -> Iterator[tuple[str, str]]:
            if isinstance(value, Mapping) and value:
                for key in sorted(value):
                    yield from walk(f"{head}.{key}" if head else str(key), value[key])
            else:
                yield head, json.dumps(value, ensure_ascii=False)

        return walk("", self.values)
