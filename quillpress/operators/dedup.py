"""Repeated blocks and lines inside one text, replaced by references to their section.

Groups of equal blocks are taken in a fixed order: more lines first, then by first place; a line
that a group has looked at is not looked at again, whether or not it was replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import regex

from .textlines import ALNUM, size, split_lines

_TITLE = regex.compile(rf"[{ALNUM}\-_ ]+")
MIN_LINES, MAX_LINES, MAX_SIMILAR, MIN_BLOCK, MIN_LINE, KEY = 3, 15, 10, 30, 20, 20


def is_heading(line: str) -> bool:
    """A # heading, or a short `title:`."""
    line = line.strip()
    if line.startswith("#"):
        return True
    title = line.rstrip(":")
    return line.endswith(":") and not line.startswith(("`", "[")) and 0 < size(title) < 80 and (" " not in title or bool(_TITLE.fullmatch(title)))


def deduplicate(text: str) -> str:
    lines = split_lines(text)
    n = len(lines)
    if n < 6:
        return text
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(x, len(numbers)) for x in lines]
    bytes_to = [0, *accumulate(size(x) + 1 for x in lines)]
    full_to = [0, *accumulate(bool(x.strip()) for x in lines)]
    ticks_to = [0, *accumulate(x.count("```") for x in lines)]
    full = [i for i, x in enumerate(lines) if x.strip()]
    following = dict(zip(full, full, strict=True))
    sections = list(accumulate(is_heading(x) for x in lines))
    used = bytearray(n)
    cuts: dict[int, tuple[int, str]] = {}

    def weighty(s: int, e: int) -> bool:
        return bytes_to[e] - bytes_to[s] - 1 >= MIN_BLOCK and full_to[e] > full_to[s]

    def one_fence(s: int, e: int) -> bool:
        if ticks_to[e] - ticks_to[s] != 2:
            return False
        first = next(i for i in range(s, e) if i in following)
        last = next(i for i in range(e - 1, s - 1, -1) if i in following)
        return lines[first].strip().startswith("```") and lines[last].strip().endswith("```")

    def claim(spans: Iterable[tuple[int, int]]) -> None:
        """Of the spans that are still free the first stays and the others become references."""
        free = []
        for s, e in spans:
            if not any(used[s:e]):
                used[s:e] = b"\1" * (e - s)
                free.append((s, e))
        for s, e in free[1:]:
            cuts[s] = (e, f"[see §{max(1, sections[free[0][0]])}]")

    if len(numbers) < n:  # equal blocks are made of equal triples of lines
        triples = list(zip(ids, ids[1:], ids[2:], strict=False))
        often = Counter(triples)
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        reach = [0] * (n + 1)  # the end of the longest block from a line on that can be a repeated one
        for s in range(n - MIN_LINES, -1, -1):
            reach[s] = 0 if often[triples[s]] < 2 else max(reach[s + 1], s + MIN_LINES)
        for s in range(n):
            for e in range(s + MIN_LINES, min(s + MAX_LINES, reach[s]) + 1):
                if weighty(s, e) and not one_fence(s, e):
                    blocks.setdefault(tuple(ids[s:e]), []).append((s, e))
        for _, spans in sorted(((len(k), v) for k, v in blocks.items() if len(v) > 1), key=lambda x: (-x[0], x[1][0])):
            claim(spans)

    alike: dict[str, list[tuple[int, int]]] = {}
    for i, line in enumerate(lines):
        line = line.strip()
        if not used[i] and size(line) >= MIN_LINE and not line.startswith(("#", "`")):
            alike.setdefault(line, []).append((i, i + 1))
    for spans in alike.values():
        if len(spans) > 1:
            claim(spans)

    # Blocks that start alike: of the spans from one start the longest that is free is taken.
    free_to, end = [0] * n, n
    for s in range(n - 1, -1, -1):
        end = s if used[s] else end
        free_to[s] = end
    similar: dict[str, list[tuple[int, int, int]]] = {}
    for s in range(n):
        top, low = min(s + MAX_SIMILAR, free_to[s]), s + MIN_LINES
        while low <= top and not weighty(s, low):
            low += 1
        if low > top:
            continue
        key = _head(lines, s, low)
        spans = [(key, low, top)] if len(key) == KEY else [(_head(lines, s, e), e, e) for e in range(top, low - 1, -1)]
        for key, low, top in spans:
            if size(key) >= 15:
                similar.setdefault(key, []).append((s, low, top))
    for spans in similar.values():
        if sum(top - low + 1 for _, low, top in spans) > 1:
            claim((s, e) for s, low, top in spans if (e := _free(used, s, top)) >= low)

    if not cuts:
        return text
    out, i = [], 0
    while i < n:
        i, line = cuts.get(i) or (i + 1, lines[i])
        out.append(line + "\n")
    return "".join(out)


def _free(used: bytearray, s: int, top: int) -> int:
    """The end of the free lines from s on, top at most."""
    at = used.find(1, s, top)
    return top if at < 0 else at


def _head(lines: list[str], s: int, e: int) -> str:
    """The first 20 characters of lines s to e joined."""
    head = lines[s]
    while len(head) < KEY and s + 1 < e:
        s += 1
        head += "\n" + lines[s]
    return head[:KEY]


def section_of(text: str, line: int) -> int:
    """The number of the section that a line lies in, from 1."""
    return max(1, sum(map(is_heading, split_lines(text)[: line + 1])))


def references(text: str) -> int:
    return len(re.findall(r"^\[see §\d+\]$", text, re.M))
