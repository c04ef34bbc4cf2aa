"""Levels 3 and 4: keys, markers and groups instead of sections, and the size guards between them."""

from __future__ import annotations

import regex

from ..config import Config, Level
from .textlines import ALNUM, join_lines, size, split_lines

#: The line that explains the markers.
LEGEND = "[marks: -=list +=done !=todo]\n"
# Fence languages and their short names.
LANGUAGES = (("python", "py"), ("bash", "sh"), ("javascript", "js"), ("typescript", "ts"), ("markdown", "md"))
_TITLE = regex.compile(rf"[{ALNUM}\-_ &,./():;!?'\"@#$%+=~`]+")
_MARKERS = regex.compile(r"(?:- )*(?:\* )*")


def heading_of(line: str) -> str | None:
    """The title of `title: text` or `title:`."""
    line = line.strip()
    title, colon, _ = line.partition(": ")
    if colon and _TITLE.fullmatch(title):
        return title
    return line[:-1] if line.endswith(":") and _TITLE.fullmatch(line[:-1]) else None


def _after_colon(line: str) -> str:
    return line.partition(": ")[2].strip()


def level_3(text: str) -> str:
    out = []
    for line in split_lines(text):
        trimmed, indent = line.strip(), "  " if line.startswith(" ") else ""
        if (title := heading_of(line)) is not None:
            content = _after_colon(line)
            out.append(f"{title}: {content}" if content else f"{title}:")
        elif trimmed.startswith(("+ ", "! ")):
            out.append(indent + trimmed)
        elif line.lstrip().startswith(("- ", "* ")):
            out.append(f"{indent}- {_MARKERS.sub('', trimmed, count=1)}")
        elif line:
            out.append(line)
    return join_lines(out)


def level_4(text: str) -> str:
    lines, out = split_lines(text), []
    group: list[str] | None = None
    for i, line in enumerate(lines):
        trimmed = line.strip()
        below = lines[i + 1] if i + 1 < len(lines) else ""
        if (title := heading_of(line)) is not None:
            group = [x for x in (_after_colon(line),) if x]
            out.append((title, group))
        elif group is not None:
            if trimmed:
                group.append(trimmed)
        elif trimmed.startswith(("+ ", "! ")):
            out.append(trimmed[0] + trimmed[2:] + (" " if below.strip().startswith(("+ ", "! ")) else "\n"))
        elif line.startswith(("- ", "* ")):
            out.append("-" + _MARKERS.sub("", line, count=1) + (" " if below.startswith(("- ", "* ")) else "\n"))
        elif trimmed:
            out.append(trimmed + "\n")
    text = "".join(x if isinstance(x, str) else f"{x[0]}{{{' '.join(x[1])}}}\n" for x in out)
    for name, short in LANGUAGES:
        for fence in ("{``````", "{````"):
            text = text.replace(f"{fence}{name} ", f"{fence}{short} ")
    return text


def restructure(text: str, config: Config) -> str:
    """The shortest of the text, its level 3 form and, at level 4, its level 4 form."""
    if config.level < Level.STRUCTURED:
        return text
    third = level_3(text)
    legend = LEGEND if config.legend and any(x.strip().startswith(("- ", "+ ", "! ")) for x in split_lines(third)) else ""
    best = legend + third if size(legend + third) < size(text) else text
    if config.level is Level.ULTRA:
        fourth = legend + level_4(text)
        best = fourth if size(fourth) <= size(best) else best
    return best
