"""Paired marks of Markdown, as patterns for Python and for Spark alike."""

from __future__ import annotations

import re

# Fixed values, the format's own: marks that stand on both sides of a text, in the order in which they are taken off.
PAIRED = ("**", "__", "*", "_", "~~", "`")
#: The same for what stands in brackets: how it opens, how it closes, and whether a target in parentheses follows.
BRACKETED = (("[[", "]]", False), ("[", "]", True))


def pair(mark: str) -> str:
    """A text between two marks, the text as group 1.

    A mark of two characters takes the least text that it can; one of one character does not stand
    beside its like, and an underscore not within a word either; ticks hold no tick.
    """
    own = re.escape(mark)
    if mark == "`":
        return f"{own}([^{own}]+){own}"
    if len(mark) > 1:
        return f"{own}(.+?){own}"
    lone = f"(?<!{own}){own}(?!{own})"
    before, after = (r"(?<![\w`])", r"(?![\w`])") if mark == "_" else ("", "")
    return f"{before}{lone}(.+?){lone}{after}"


def bracket(opens: str, closes: str, target: bool) -> str:
    """A text in brackets as group 1, which holds no closing bracket, with its target."""
    inside = f"([^{re.escape(closes[0])}]+)"
    return re.escape(opens) + inside + re.escape(closes) + (r"\([^)]+\)" if target else "")


PATTERNS = tuple(map(pair, PAIRED)) + tuple(bracket(*x) for x in BRACKETED)
