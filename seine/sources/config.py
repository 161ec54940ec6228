"""Layered configuration: defaults, files, environment, request; and its export."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..operators.predicates import BINARY_EXTENSIONS, FILTERED_DIRECTORIES, IGNORE_COMMENTS, IGNORE_NEXT, IGNORED_PATHS, IGNORED_SUBSTRINGS, TEST_ATTRIBUTES, TEST_MODULES


@dataclass(frozen=True)
class ScanConfig:
    """What a scan does. Lists given with a request extend those of the configuration; other values replace them."""

    entropy: bool = True
    threshold: float = 1e-5
    max_file_mib: int = 10
    whole_mib: int = 5
    include_binary: bool = False
    follow_symlinks: bool = False
    ignore_paths: tuple[str, ...] = IGNORED_PATHS
    ignore_patterns: tuple[str, ...] = IGNORED_SUBSTRINGS
    ignore_comments: tuple[str, ...] = IGNORE_COMMENTS
    ignore_next: str = IGNORE_NEXT
    ignore_test_code: bool = True
    test_attributes: tuple[str, ...] = TEST_ATTRIBUTES
    test_modules: tuple[str, ...] = TEST_MODULES
    directories: tuple[str, ...] = FILTERED_DIRECTORIES
    binary_extensions: tuple[str, ...] = BINARY_EXTENSIONS
    custom_patterns: tuple[str, ...] = ()
    bigrams: tuple[str, ...] | None = None
    strict_groups: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict)

    def extended(self, **more: Any) -> ScanConfig:
        """With request values: lists are appended, other values replace."""
        out = {}
        for k, v in more.items():
            old = getattr(self, k)
            out[k] = (*old, *v) if isinstance(old, tuple) and v is not None else v
        return replace(self, **out)


def merge(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers win; nested tables are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_environment(env: Mapping[str, str], prefix: str = "SEINE_") -> dict[str, Any]:
    """SEINE_A__B=x is {"a": {"b": x}}; empty values are left out; JSON values are read as such."""
    out: dict[str, Any] = {}
    for key, raw in env.items():
        if key.startswith(prefix) and raw:
            *path, last = key[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = json.loads(raw)
            except ValueError:
                at[last] = raw
    return out


def load_file(path: str | Path) -> dict[str, Any]:
    """A TOML, JSON or YAML file on the driver; YAML needs a YAML package. An empty file is an empty configuration."""
    raw = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(raw) if raw.strip() else {}
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML package is installed") from e
        return yaml.safe_load(raw) or {}
    return tomllib.loads(raw)


SUFFIXES = (".toml", ".yaml", ".yml", ".json")


def found_files(start: str | Path, name: str = "seine", system: str | Path = "/etc", home: str | Path | None = None) -> list[Path]:
    """The configuration files that hold for a folder, from the lowest precedence to the highest: the system's
    (system/name/name.*), the user's (home/.config/name/name.*), and those named name.* or .name.* in the folder's parents,
    from the top down to itself."""
    home = Path(home) if home else Path.home()
    folders = [Path(system) / name, home / ".config" / name, *reversed(Path(start).resolve().parents), Path(start).resolve()]
    stems = [(f, (name,) if i < 2 else (name, f".{name}")) for i, f in enumerate(folders)]
    return [f / f"{stem}{suffix}" for f, names in stems for stem in names for suffix in SUFFIXES if (f / f"{stem}{suffix}").is_file()]


def layered(start: str | Path = ".", custom: str | Path | None = None, env: Mapping[str, str] | None = None, request: Mapping[str, Any] | None = None, **places: Any) -> dict[str, Any]:
    """The merged configuration: found files, a custom file, the environment, and the request, each above the ones before."""
    layers = [load_file(f) for f in found_files(start, **places)]
    layers += [load_file(custom)] if custom else []
    return merge(*layers, from_environment(os.environ if env is None else env), request or {})


def problems(tree: Mapping[str, Any]) -> list[str]:
    """What is wrong with the `scanner` table of a configuration: unknown keys, and values of another kind than their default's."""
    kinds = {f.name: type(getattr(ScanConfig(), f.name)) for f in fields(ScanConfig) if f.name != "extra"} | {"bigrams": tuple, "bigrams_file": str}
    out = []
    for k, v in (get(tree, "scanner") or {}).items():
        if k not in kinds:
            out.append(f"unknown key: scanner.{k}")
            continue
        want = (list, tuple) if kinds[k] is tuple else (int, float) if kinds[k] is float else kinds[k]
        if not isinstance(v, want) or (isinstance(v, bool) and kinds[k] is not bool):
            out.append(f"scanner.{k}: {type(v).__name__} in place of {'list' if kinds[k] is tuple else kinds[k].__name__}")
    return out


def load_bigrams(path: str | Path) -> tuple[str, ...]:
    """A table of pairs for the randomness gate from a text file: pairs parted by commas or line feeds, in any order."""
    pairs = tuple(dict.fromkeys(p for p in re.split(r"[,\r\n]", Path(path).read_text(encoding="utf-8")) if p))
    if bad := [p for p in pairs if len(p.encode()) != 2]:
        raise ValueError(f"{path}: not a pair: {bad[0]!r}")
    return pairs


def get(tree: Mapping[str, Any], dotted: str, default: Any = None) -> Any:
    at: Any = tree
    for part in dotted.split("."):
        if not isinstance(at, Mapping) or part not in at:
            return default
        at = at[part]
    return at


def scan_config(tree: Mapping[str, Any]) -> ScanConfig:
    """The `scanner` table of a configuration. Symlinks, file sizes and extensions are request values and are not read from it."""
    skipped = {"follow_symlinks", "max_file_mib", "binary_extensions", "extra"}
    known = {f.name for f in fields(ScanConfig)} - skipped
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in (get(tree, "scanner") or {}).items() if k in known}
    if table := get(tree, "scanner.bigrams_file"):
        given["bigrams"] = load_bigrams(table)
    return ScanConfig(**given, extra={k: v for k, v in tree.items() if k != "scanner"})


def _toml(tree: Mapping[str, Any], prefix: str = "") -> Iterable[str]:
    plain = {k: v for k, v in tree.items() if not isinstance(v, Mapping)}
    for k, v in plain.items():
        if v is not None:
            yield f"{k} = {json.dumps(v, ensure_ascii=False)}"
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield f"\n[{prefix}{k}]"
            yield from _toml(v, f"{prefix}{k}.")


def _yaml(tree: Mapping[str, Any], depth: int = 0) -> Iterable[str]:
    pad = "  " * depth
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield f"{pad}{k}:" if v else f"{pad}{k}: {{}}"
            yield from _yaml(v, depth + 1)
        else:
            yield f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"


def export(tree: Mapping[str, Any], kind: str) -> str:
    """As json, toml or yaml."""
    if kind == "json":
        return json.dumps(tree, indent=2, ensure_ascii=False)
    if kind == "toml":
        return "\n".join(_toml(tree)).lstrip("\n") + "\n"
    if kind == "yaml":
        return "\n".join(_yaml(tree)) + "\n"
    raise ValueError(f"unknown format: {kind}")
