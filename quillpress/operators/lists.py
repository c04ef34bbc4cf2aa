"""Lists and tiny sections of one text."""

from __future__ import annotations

import re
from itertools import groupby

from .textlines import join_lines, size, split_lines

_ITEM = re.compile(r"( *)[-*] ")
_MARKERS = re.compile(r"(?:- )*(?:\* )*")


def flatten_nested(text: str) -> str:
    """Every top-level item and its nested items as one line: `item: child, child`."""
    out: list[str] = []
    open_items: list[list] = []  # from the top-level item down: [own text, children's texts]

    def close(depth: int) -> None:
        while len(open_items) > depth:
            own, children = open_items.pop()
            line = f"{own}: {', '.join(children)}" if children else own
            (open_items[-1][1] if open_items else out).append(line)

    for line in split_lines(text):
        m = _ITEM.match(line)
        depth, odd = divmod(len(m[1]), 2) if m else (-1, 0)
        if m and not odd and depth <= len(open_items) and (depth or not line.startswith(" ")):
            close(depth)
            own = _MARKERS.sub("", line.strip(), count=1)
            open_items.append(["  " * depth + own, []])
        elif not (open_items and not line.strip()):
            close(0)
            out.append(line)
    close(0)
    return join_lines(out)


def inline_tiny_sections(text: str) -> str:
    """`title:` and a short line below it as one line, outside of code."""
    lines, out = split_lines(text), []
    i, code = 0, False
    while i < len(lines):
        line, below = lines[i], lines[i + 1].strip() if i + 1 < len(lines) else ""
        if line.startswith("```"):
            code = not code
        elif not code and line.endswith(":") and not line.startswith((" ", "@")) and below and size(below) <= 50 and not below.startswith(("- ", "* ")) and not below.endswith(":"):
            out.append(f"{line.rstrip(':')}: {below}")
            i += 2
            continue
        out.append(line)
        i += 1
    return join_lines(out)


def merge_short_items(text: str) -> str:
    """Runs of short items of one indentation, without commas, as one item."""

    def key(line: str):
        trimmed = line.strip()
        short = trimmed.startswith(("- ", "* ")) and size(trimmed[2:]) <= 50 and "," not in trimmed[2:]
        return line[: len(line) - len(trimmed)] if short else None

    out: list[str] = []
    for indent, run in groupby(split_lines(text), key):
        run = list(run)
        out += run if indent is None or len(run) == 1 else [f"{indent}- {', '.join(x.strip()[2:] for x in run)}"]
    return join_lines(out)
