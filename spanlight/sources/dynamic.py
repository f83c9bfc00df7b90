"""Side inputs of rules: small files read on the driver, with caching, extraction and templates."""

from __future__ import annotations

import csv
import io
import json
import re
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

MAX_BYTES = 64 << 20


def parse_data(text: str, kind: str) -> Any:
    """``json``, ``yaml``, ``lines`` (blank ones left out) or ``csv`` (a list of mappings)."""
    if kind == "json":
        return json.loads(text)
    if kind == "yaml":
        return yaml.safe_load(text)
    if kind == "lines":
        return [line.strip() for line in text.splitlines() if line.strip()]
    if kind == "csv":
        return list(csv.DictReader(io.StringIO(text)))
    raise ValueError(f"unknown format {kind!r}")


def extract(data: Any, path: str) -> Any:
    """A JSONPath or jq-like path (``$.a[*].b``, ``.a[].b``, ``.a[0]``): nothing -> None, one value, or a list."""
    steps = re.findall(r"\.?([A-Za-z_][\w\-]*)|\[(\*|-?\d*)\]|\['([^']+)'\]", path.lstrip("$"))
    found = [data]
    for name, index, quoted in steps:
        key = name or quoted
        following: list = []
        for value in found:
            if key:
                if isinstance(value, dict) and key in value:
                    following.append(value[key])
            elif index in ("*", ""):
                following += value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else []
            elif isinstance(value, list) and -len(value) <= int(index) < len(value):
                following.append(value[int(index)])
        found = following
    return None if not found else found[0] if len(found) == 1 else found


@dataclass
class Source:
    """A side input: where it is, how it is read, what happens when that fails (``use_cached``, ``fail``, ``default``)."""

    id: str
    path: str
    format: str = "json"
    extract: str | None = None
    refresh_s: float | None = None
    on_error: str = "use_cached"
    default: Any = None


@dataclass
class Sources:
    """Loads sources and keeps them for their refresh time."""

    sources: dict[str, Source]
    cache: dict[str, tuple[float, Any]] = field(default_factory=dict)

    def get(self, name: str) -> Any:
        source = self.sources[name]
        cached = self.cache.get(name)
        if cached and (source.refresh_s is None or time.monotonic() - cached[0] < source.refresh_s):
            return cached[1]
        try:
            file = Path(source.path)
            if file.stat().st_size > MAX_BYTES:
                raise ValueError(f"{source.path} is larger than {MAX_BYTES} bytes")
            data = parse_data(file.read_text(encoding="utf-8"), source.format)
            value = extract(data, source.extract) if source.extract else data
        except (OSError, ValueError, yaml.YAMLError):
            if source.on_error == "use_cached" and cached:
                return cached[1]
            if source.on_error == "default":
                return source.default
            raise
        self.cache[name] = (time.monotonic(), value)
        return value

    def expand(self, value: Any) -> Any:
        """``${source.name.path}`` in texts, lists and mappings; a text that is only a reference takes its value's type,
        and a list in a list is spliced in."""
        if isinstance(value, dict):
            return {k: self.expand(v) for k, v in value.items()}
        if isinstance(value, list):
            out: list = []
            for item in value:
                new = self.expand(item)
                out += new if isinstance(new, list) and isinstance(item, str) else [new]
            return out
        if isinstance(value, str):
            whole = re.fullmatch(r"\$\{source\.([\w-]+)((?:[.\[][^}]*)?)\}", value)
            if whole:
                return extract(self.get(whole[1]), whole[2]) if whole[2] else self.get(whole[1])
            return re.sub(r"\$\{source\.([\w-]+)((?:[.\[][^}]*)?)\}", lambda m: str(extract(self.get(m[1]), m[2]) if m[2] else self.get(m[1])), value)
        return value


def expand_includes(document: Any, folder: str, above: tuple[str, ...] = ()) -> Any:
    """A document with every ``include: file`` (or list of files) mapping replaced by what the files hold: mappings are merged,
    the document's own members winning; a list element that is only an include is replaced by the file's elements.

    Files are relative to ``folder`` and may not lie outside of it; files that include each other are an error.
    """
    def read(name: str) -> Any:
        root = Path(folder).resolve()
        path = (root / name).resolve()
        if not path.is_relative_to(root):
            raise ValueError(f"{name} lies outside of {folder}")
        if str(path) in above:
            raise ValueError(f"{name} includes itself")
        kind = "json" if path.suffix == ".json" else "yaml"
        return expand_includes(parse_data(path.read_text(encoding="utf-8"), kind), folder, (*above, str(path)))

    if isinstance(document, list):
        out: list = []
        for x in document:
            if isinstance(x, dict) and set(x) == {"include"}:
                for name in x["include"] if isinstance(x["include"], list) else [x["include"]]:
                    held = read(name)
                    out += held if isinstance(held, list) else [held]
            else:
                out.append(expand_includes(x, folder, above))
        return out
    if isinstance(document, dict):
        merged: dict = {}
        for name in document["include"] if isinstance(document.get("include"), list) else [document["include"]] if isinstance(document.get("include"), str) else []:
            held = read(name)
            if not isinstance(held, dict):
                raise ValueError(f"{name} is no mapping")
            merged |= held
        return merged | {k: expand_includes(v, folder, above) for k, v in document.items() if k != "include"}
    return document
