"""Lines of one text, in Python: what the per-document operators share."""

from __future__ import annotations

import regex

#: What counts as a word character in prose: alphabetic or any number.
ALNUM = r"\p{Alphabetic}\p{N}"
_ALNUM = regex.compile(f"[{ALNUM}]")


def split_lines(text: str) -> list[str]:
    """Lines that end at \\n or \\r\\n; no empty line after the last end."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    return lines


def join_lines(lines: list[str]) -> str:
    """Every line ended by \\n."""
    return "".join(f"{x}\n" for x in lines)


def size(text: str) -> int:
    """Bytes of UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def is_alnum(char: str) -> bool:
    return bool(_ALNUM.match(char))
