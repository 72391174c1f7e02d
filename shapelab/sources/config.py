"""Settings files: [SECTION], `key = value`, // comments. A later file overrides an earlier one; unknown lines warn."""

from __future__ import annotations

import warnings


def parse(text: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    section = ""
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("//", 1)[0].strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
            out.setdefault(section, {})
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            out.setdefault(section, {})[key] = value
        else:
            warnings.warn(f"line {n} is no setting: {line}", stacklevel=2)
    return out


def merged(*texts: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for text in texts:
        for section, values in parse(text).items():
            out.setdefault(section, {}).update(values)
    return out


def as_bool(value: str) -> bool:
    v = value.strip().lower()
    if v not in ("true", "false"):
        raise ValueError(f"neither true nor false: {value}")
    return v == "true"


def as_list(value: str) -> list[float]:
    return [float(x) for x in value.replace(",", " ").split()]
