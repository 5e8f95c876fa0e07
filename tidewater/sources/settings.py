"""Configuration from TOML and environment, and the saved node state: unknown keys and impossible values are errors."""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "TIDEWATER_"
STATE_BYTES, STATE_NODES = 1 << 20, 300


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Queue:
    most: int = 5_000_000
    lease_seconds: int = 120
    claim: int = 512
    cooldown_days: int = 7

    def check(self) -> None:
        _need(self.most > 0 and self.lease_seconds > 0 and 0 < self.claim <= 10_000 and self.cooldown_days >= 0, "queue")


@dataclass(frozen=True)
class Scrape:
    unknown_seconds: int = 86_400
    live_seconds: int = 604_800
    threshold: int = 0
    fresh_seconds: int = 1_209_600

    def check(self) -> None:
        _need(self.unknown_seconds > 0 and self.live_seconds > 0 and self.threshold >= 0 and self.fresh_seconds > 0, "scrape")


@dataclass(frozen=True)
class Index:
    path: str = "index"
    page_rows: int = 1000
    poll_seconds: float = 1.0
    grace_seconds: int = 3600

    def check(self) -> None:
        _need(bool(self.path) and 0 < self.page_rows <= 1000 and self.poll_seconds > 0 and self.grace_seconds >= 0, "index")


@dataclass(frozen=True)
class Search:
    per_page: int = 20
    cache_pages: int = 100
    cache_seconds: int = 900

    def check(self) -> None:
        _need(0 < self.per_page <= 50 and self.cache_pages >= 0 and self.cache_seconds >= 0, "search")


@dataclass(frozen=True)
class Settings:
    queue: Queue = field(default_factory=Queue)
    scrape: Scrape = field(default_factory=Scrape)
    index: Index = field(default_factory=Index)
    search: Search = field(default_factory=Search)

    def validate(self) -> Settings:
        for f in dataclasses.fields(self):
            getattr(self, f.name).check()
        return self


def _need(ok: bool, section: str) -> None:
    if not ok:
        raise SettingsError(f"a value of [{section}] is out of range")


def _typed(kind: str, value, where: str):
    """A value of the field's type; text (from the environment) is converted."""
    want = {"int": int, "float": float, "str": str, "bool": bool}[kind]
    if isinstance(value, str) and want is not str:
        try:
            return want(value)
        except ValueError:
            raise SettingsError(f"{where} is no {kind}") from None
    if want is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, want) or (isinstance(value, bool) and want is not bool):
        raise SettingsError(f"{where} is no {kind}")
    return value


def parse(text: str = "", environment: Mapping[str, str] | None = None) -> Settings:
    """TOML text, over which ``TIDEWATER_SECTION__KEY`` wins."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise SettingsError(str(error)) from None
    for name, value in (environment or {}).items():
        if name.startswith(PREFIX) and "__" in name:
            section, key = name[len(PREFIX) :].lower().split("__", 1)
            given.setdefault(section, {})[key] = value
    sections = {f.name: f.default_factory for f in dataclasses.fields(Settings)}
    made = {}
    for section, values in given.items():
        if section not in sections or not isinstance(values, dict):
            raise SettingsError(f"there is no section {section}")
        kinds = {f.name: f.type for f in dataclasses.fields(sections[section])}
        if unknown := sorted(set(values) - set(kinds)):
            raise SettingsError(f"[{section}] has no {', '.join(unknown)}")
        made[section] = sections[section](**{k: _typed(kinds[k], v, f"{section}.{k}") for k, v in values.items()})
    return Settings(**made).validate()


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    text = ""
    if path is not None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return parse(text, os.environ if environment is None else environment)


def save_state(path: str, own: str, nodes: list[dict]) -> None:
    """Own id and at most 300 nodes as JSON; the file is replaced at once."""
    data = json.dumps({"id": own, "nodes": nodes[:STATE_NODES]})
    if len(data) > STATE_BYTES:
        raise SettingsError("the state is too large")
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def load_state(path: str) -> dict | None:
    """None for a missing file; a large or broken one is an error."""
    try:
        if os.path.getsize(path) > STATE_BYTES:
            raise SettingsError("the state file is too large")
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
    except FileNotFoundError:
        return None
    except ValueError as error:
        raise SettingsError(f"the state file is broken: {error}") from None
    if not isinstance(state, dict) or not isinstance(state.get("nodes"), list):
        raise SettingsError("the state file is broken")
    return {"id": state.get("id"), "nodes": state["nodes"][:STATE_NODES]}
