"""Typed settings with scopes: system, then session, then statement; the narrower wins."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from quarry.plans.errors import QuarryError

SCOPES = ("system", "session", "statement")


@dataclass(frozen=True)
class Setting:
    key: str
    kind: type
    default: object
    scopes: tuple[str, ...] = SCOPES


@dataclass
class Settings:
    known: dict[str, Setting] = field(default_factory=dict)
    values: dict[str, dict[str, object]] = field(default_factory=lambda: {s: {} for s in SCOPES})

    def register(self, *settings: Setting) -> None:
        for s in settings:
            if s.key in self.known:
                raise QuarryError("DUPLICATE_SETTING", key=s.key)
            self.known[s.key] = s

    def set(self, scope: str, key: str, value) -> None:
        if key not in self.known:
            raise QuarryError("UNKNOWN_SETTING", key=key)
        s = self.known[key]
        if scope not in s.scopes:
            raise QuarryError("SCOPE_NOT_ALLOWED", key=key, scope=scope)
        if isinstance(value, str) and s.kind is bool:
            if value.lower() not in ("true", "false"):
                raise QuarryError("BAD_VALUE", key=key, value=value)
            value = value.lower() == "true"
        try:
            self.values[scope][key] = s.kind(value)
        except (TypeError, ValueError) as e:
            raise QuarryError("BAD_VALUE", key=key, value=value) from e

    def get(self, key: str):
        if key not in self.known:
            raise QuarryError("UNKNOWN_SETTING", key=key)
        for scope in reversed(SCOPES):
            if key in self.values[scope]:
                return self.values[scope][key]
        return self.known[key].default

    def unset(self, scope: str, key: str) -> None:
        if key not in self.known:
            raise QuarryError("UNKNOWN_SETTING", key=key)
        self.values[scope].pop(key, None)

    def load_toml(self, text: str) -> None:
        """System values from TOML; tables are dotted prefixes."""

        def walk(prefix: str, node: dict):
            for k, v in node.items():
                walk(f"{prefix}{k}.", v) if isinstance(v, dict) else self.set("system", prefix + k, v)

        walk("", tomllib.loads(text))
