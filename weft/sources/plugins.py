"""Plugin registry, manifests, precedence and sandbox."""

from __future__ import annotations

import importlib
import os
import tomllib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

KINDS = ("importer", "renderer", "ai", "vector")


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    description: str = ""
    author: str = ""
    license: str = ""
    priority: int = 100


def parse_manifest(text: str) -> Manifest:
    """The [plugin] table; name and version are required."""
    got = tomllib.loads(text).get("plugin", {})
    for k in ("name", "version"):
        if not got.get(k):
            raise ValueError(f"missing field {k}")
    return Manifest(**{k: got[k] for k in Manifest.__dataclass_fields__ if k in got})


def discover(root: str) -> list[Manifest]:
    """The manifests of a folder's sub-folders by priority, version (latest first), name."""
    found = []
    for d in sorted(os.listdir(root)):
        path = os.path.join(root, d, "plugin.toml")
        if os.path.isfile(path):
            with open(path) as f:
                found.append(parse_manifest(f.read()))
    found.sort(key=lambda m: m.name)
    found.sort(key=lambda m: m.version, reverse=True)
    return sorted(found, key=lambda m: m.priority)


@dataclass
class Registry:
    """Capabilities by kind and name."""

    held: dict = field(default_factory=lambda: {k: {} for k in KINDS})
    active: dict = field(default_factory=dict)

    def register(self, kind: str, name: str, value) -> None:
        if name in self.held[kind]:
            raise ValueError(f"{kind} {name} is registered")
        self.held[kind][name] = value

    def deregister(self, kind: str, name: str) -> None:
        self.held[kind].pop(name)
        if self.active.get(kind) == name:
            del self.active[kind]

    def get(self, kind: str, name: str):
        return self.held[kind].get(name)

    def names(self, kind: str) -> list[str]:
        return sorted(self.held[kind])

    def activate(self, kind: str, name: str) -> None:
        if name not in self.held[kind]:
            raise KeyError(name)
        self.active[kind] = name


def sandboxed(f: Callable, *args, timeout: float = 30.0):
    """The result, or None if it fails or takes longer than the timeout."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(f, *args).result(timeout)
    except Exception:  # noqa: BLE001 - a plugin's failure must not end the host
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def load(entry: str):
    """A plugin by its Python entry point 'module:name'; native libraries are not loaded."""
    module, _, name = entry.partition(":")
    return getattr(importlib.import_module(module), name)
