"""Durations such as ``1w2d3h4m5s``, as whole microseconds."""

from __future__ import annotations

import re

#: Units in microseconds.
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h|d|w)")


def parse_duration(text: str) -> int:
    """Microseconds; what is finer can't be told apart and is an error."""
    body = text.strip()
    sign = -1 if body[:1] == "-" else 1
    body = body.lstrip("+-")
    if body == "0":
        return 0
    parts, at, total = [], 0, 0.0
    for m in _PART.finditer(body):
        if m.start() != at:
            break
        parts.append(m)
        at = m.end()
        total += float(m[1]) * UNITS[m[2]]
    if not parts or at != len(body):
        raise ValueError(f"invalid duration {text!r}")
    if total != int(total):
        raise ValueError(f"duration {text!r} is finer than a microsecond")
    return sign * int(total)


def _clock(us: int) -> str:
    if us < 1_000:
        return f"{us}µs"
    if us < 1_000_000:
        return f"{us / 1_000:g}ms"
    hours, rest = divmod(us, UNITS["h"])
    minutes, rest = divmod(rest, UNITS["m"])
    seconds = f"{rest / 1_000_000:.6f}".rstrip("0").rstrip(".") + "s"
    return (f"{hours}h{minutes}m" if hours else f"{minutes}m" if minutes else "") + seconds


def format_duration(us: int) -> str:
    """Weeks and days, then hours, minutes and seconds: ``1w0d23h55m0s``, ``1d``."""
    weeks, rest = divmod(us, UNITS["w"])
    days, rest = divmod(rest, UNITS["d"])
    out = f"{weeks}w" if weeks else ""
    if days or (weeks and rest):
        out += f"{days}d"
    return out + (_clock(rest) if rest else "")
