"""Driver-side parsing of option texts."""

from __future__ import annotations

import re


def parse_flags(text: str) -> int:
    """A flag mask in decimal or 0x-hexadecimal, 16 bits."""
    value = int(text, 16) if text.lower().startswith("0x") else int(text)
    if not 0 <= value < 1 << 16:
        raise ValueError(f"flag mask out of range: {text}")
    return value


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """(contig, start, end) of name, name:start or name:start-end; a bad number leaves that bound open."""
    name, _, span = text.partition(":")
    low, _, high = span.partition("-")

    def number(x: str) -> int | None:
        x = x.replace(",", "")
        return int(x) if re.fullmatch(r"\d+", x) else None

    return name, number(low), number(high)


def parse_position(text: str) -> tuple[str, int]:
    """(contig, position) of name:position."""
    name, colon, at = text.rpartition(":")
    if not colon or not at.isdigit():
        raise ValueError(f"expected name:position, got {text}")
    return name, int(at)


def parse_read_group(line: str) -> dict[str, str]:
    """The known fields of a read-group line; an ID is required."""
    fields = dict(f.split(":", 1) for f in line.removeprefix("@RG").strip("\t").replace("\\t", "\t").split("\t") if ":" in f)
    if "ID" not in fields:
        raise ValueError("read group without ID")
    return {k: fields[k] for k in ("ID", "SM", "LB", "PL", "PU", "CN", "DT", "PI", "DS") if k in fields}


def expand_pattern(pattern: str, stem: str, value: str) -> str:
    """Output name of a split: %* is the stem, %! the tag value."""
    return pattern.replace("%*", stem).replace("%!", value)
