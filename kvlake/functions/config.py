"""Layered configuration: default, then YAML-like file, then environment, then flags."""

from __future__ import annotations

from collections.abc import Mapping

from kvlake.functions.scalar import env_name, parse_bytes


def _number(text: str, low: int, high: int) -> int:
    value = int(text)
    if not low <= value <= high:
        raise ValueError(f"{value} is not in {low}..{high}")
    return value


#: Parsers of configuration values by kind.
KINDS = {
    "text": str,
    "bytes": parse_bytes,
    "port": lambda t: _number(t, 1, 65535),
    "count": lambda t: _number(t, 0, (1 << 63) - 1),
    "flag": lambda t: {"true": True, "false": False, "1": True, "0": False}[t.lower()],
}


def load(spec: Mapping[str, tuple[str, str]], prefix: str, file: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, args: Mapping[str, str] | None = None) -> dict[str, object]:
    """Values by dotted path. spec: path to (kind, default text). Unknown paths in the file or flags are errors, as are values that do not parse."""
    file, env, args = file or {}, env or {}, args or {}
    if unknown := (set(file) | set(args)) - set(spec):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for path, (kind, default) in spec.items():
        text = args.get(path, env.get(env_name(prefix, path), file.get(path, default)))
        try:
            out[path] = KINDS[kind](text)
        except (ValueError, KeyError) as e:
            raise ValueError(f"{path}: {text!r} is no {kind}") from e
    return out
