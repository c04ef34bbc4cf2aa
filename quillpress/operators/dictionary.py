"""A dictionary of substrings that one text repeats, and its expansion."""

from __future__ import annotations

import re

import numpy as np
import regex

from .textlines import ALNUM, is_alnum, size, split_lines

# Length of a seed, occurrences, characters to look back, bytes at most, entries at most.
SEED, REPEATS, BACK, LONGEST, ENTRIES = 12, 4, 10, 60, 30
_BEFORE = regex.compile(rf"[{ALNUM}_/.\-']")
_AFTER = regex.compile(rf"[{ALNUM}_/.\-]")
_BARRED = re.compile(r"\n|\]\(|[<>`]")
_ALNUMS = regex.compile(f"[{ALNUM}]")


def candidates(text: str) -> list[tuple[str, int]]:
    """(substring, count) by what they save, none part of another, 30 at most."""
    n = len(text)
    at = range(n + 1) if text.isascii() else _offsets(text)
    if at[n] < 2 * SEED or n <= SEED:
        return []
    frequent = often(text)
    places: dict[str, list[int]] = {}
    for i in frequent:
        places.setdefault(text[i : i + SEED], []).append(i)
    places = {seed: at_ for seed, at_ in places.items() if len(at_) >= REPEATS}
    found: list[tuple[str, int]] = []
    tried: dict[str, int] = {}
    covered = bytearray(n)
    for i in frequent:
        if covered[i] or (same := places.get(text[i : i + SEED])) is None:
            continue
        other = same[0] if same[0] != i else same[1]
        s = i
        while s > 0 and at[i] - at[s] < BACK and _BEFORE.match(text[s - 1]):
            s -= 1
        back = at[i] - at[s]
        limit = min(LONGEST, at[n] - at[s], at[n] - (at[other] - back if back <= at[other] else at[other]))
        e = i + SEED
        while e < n and at[e] < at[s] + limit and _AFTER.match(text[e]):
            e += 1
        part = text[s:e].strip()
        if size(part) < SEED or _BARRED.search(part) or not (is_alnum(part[0]) or part[0] == "/"):
            continue
        alnums = len(_ALNUMS.findall(part))
        if alnums < 5 or alnums / size(part) < 0.4:
            continue
        if part not in tried:
            tried[part] = text.count(part)
        count = tried[part]
        if count < REPEATS or _saved(part, count) <= 0:
            continue
        found.append((part, count))
        covered[s:e] = b"\1" * (e - s)
    kept: list[tuple[str, int]] = []
    for part, count in sorted(found, key=lambda x: -_saved(*x)):
        if not any(part in x or x in part for x, _ in kept):
            kept.append((part, count))
    return kept[:ENTRIES]


def _offsets(text: str) -> list[int]:
    """Where each character starts in bytes of UTF-8, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return [0, *np.cumsum(sizes).tolist()]


def often(text: str, length: int = SEED, least: int = REPEATS) -> list[int]:
    """Places of substrings that occur often, by a hash of each, in order; the last place of the text is left out."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - length
    if n < 1:
        return []
    hashes = np.zeros(n, np.uint64)
    for j in range(length):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    order = np.argsort(hashes)
    ranked = hashes[order]
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    many = np.diff(edges) >= least
    if not many.any():
        return []
    return np.sort(order[np.repeat(many, np.diff(edges))]).tolist()


def _saved(part: str, count: int) -> int:
    return size(part) * count - size(part) - 3 * count


def compress(text: str) -> str:
    """Header and text with references, or the text itself where that is not shorter."""
    entries = candidates(text)
    if not entries:
        return text
    keys = {part: f"@m{i}" for i, (part, _) in enumerate(entries, 1)}
    header = "@dict:\n" + "".join(f"  {key}: {part}\n" for part, key in keys.items())
    # a reference is reckoned two bytes longer than it is
    if size(header) > sum(max(0, size(part) - len(keys[part]) - 2) * count for part, count in entries):
        return text
    pattern = re.compile("|".join(map(re.escape, sorted(keys, key=size, reverse=True))))
    pieces = text.split("```")  # every other piece is code
    pieces[::2] = [pattern.sub(lambda m: keys[m[0]], x) for x in pieces[::2]]
    out = header + "```".join(pieces)
    return text if size(out) > size(text) else out


def parse(text: str) -> dict[str, str]:
    """The entries of a text's header."""
    entries, inside = {}, False
    for line in split_lines(text):
        if line.startswith("@dict:"):
            inside = True
        elif inside and line.startswith("  @"):
            key, colon, value = line.strip().partition(": ")
            if colon:
                entries[key] = value
        else:
            inside = False
    return entries


def strip_header(text: str) -> str:
    return "\n".join(x for x in split_lines(text) if not x.startswith(("@dict:", "  @")))


def expand(text: str) -> str:
    """The body with its references replaced, the longest keys first."""
    entries, inside = parse(text), False
    body = []
    for line in split_lines(text):
        inside = line.startswith("@dict:") or inside and line.startswith("  @")
        if not inside:
            body.append(line)
    out = "\n".join(body)
    for key in sorted(entries, key=len, reverse=True):
        out = out.replace(key, entries[key])
    return out
