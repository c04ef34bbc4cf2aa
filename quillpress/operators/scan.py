"""Markdown decorations: what a text's structure lets us drop or shorten.

A block scanner goes line by line (fences, HTML blocks and comments, thematic breaks, headings,
tables, list items); what is left is prose, in which delimiter runs are paired by CommonMark's
rules.  Only the outermost of nested marks is dropped, as the inner ones lie inside an edit.
"""

from __future__ import annotations

import re

from ..config import CodeMode, Level
from .textlines import size

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_TASK = re.compile(r"([ \t]*)[-*+][ \t]+\[([ x])\] (.*)$")
_DELIMITER_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
# Names that open an HTML block.
_BLOCK_TAGS = """address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem
nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"""
_HTML = re.compile(rf" {{0,3}}(?:<!--|</?(?:{'|'.join(_BLOCK_TAGS.split())})(?:[\s/>]|$)|<(?:script|pre|style|textarea)(?:[\s>]|$)|<[?!A-Z])", re.I)
_RAW_END = ((re.compile(r" {0,3}<!--"), "-->"), (re.compile(r" {0,3}<(script|pre|style|textarea)\b", re.I), None), (re.compile(r" {0,3}<\?"), "?>"))
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_MARKS = re.compile(r"`+|\\.|<!--.*?-->|<[A-Za-z/][^<>\n]*>|\*+|_+|~+|\[[^\[\]\n]*\]\([^()\n]*\)", re.S)


def strip_inline(text: str) -> str:
    """Drop the outermost emphasis, strong and strikethrough marks, and comments; code spans, links' targets and tags stay."""
    if not any(c in text for c in "*_~<"):
        return text
    runs: list[list] = []  # [position, char, left, can open, can close]
    cuts: list[tuple[int, int]] = []
    at = 0
    while m := _MARKS.search(text, at):
        s, e = m.span()
        mark = m[0]
        at = e
        if mark[0] == "`":  # a code span ends at a run of the same length
            close = re.compile(rf"(?<!`){mark}(?!`)").search(text, e)
            at = close.end() if close else e
        elif mark.startswith("<!--"):
            cuts.append((s, e))
        elif mark[0] == "[":  # the label may hold marks, the target may not
            at = s + 1
            runs.append([text.index("](", s), "]", 0, False, False, e])
        elif mark[0] in "*_~":
            if runs and len(runs[-1]) == 6 and runs[-1][0] < s < runs[-1][5]:
                at = runs[-1][5]
                continue
            before, after = text[s - 1 : s] or " ", text[e : e + 1] or " "
            left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
            right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
            if mark[0] == "_":
                opens, closes = left and (not right or _punctuation(before)), right and (not left or _punctuation(after))
            else:
                opens, closes = left, right
            if mark[0] != "~" or len(mark) <= 2:
                runs.append([s, mark[0], len(mark), opens, closes])
    spans = _pair([x for x in runs if len(x) == 5])
    end = -1
    for s, e, n in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s < end:  # inside an edited span
            continue
        end = e
        if e - s > 2 * n:
            cuts += [(s, s + n), (e - n, e)]
    out, at = [], 0
    for s, e in sorted(cuts):
        if s >= at:
            out.append(text[at:s])
            at = e
    return "".join([*out, text[at:]])


def _punctuation(char: str) -> bool:
    return not char.isalnum() and not char.isspace()


def _pair(runs: list[list]) -> list[tuple[int, int, int]]:
    """(start, end, length of the mark) of matched marks, by a stack of openers."""
    spans, stack = [], []
    for pos, char, left, opens, closes in runs:
        start = pos
        while closes and left:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == char and (char != "~" or stack[k][2] == left) and not ((stack[k][4] or opens) and char != "~" and (stack[k][5] + left) % 3 == 0 and (stack[k][5] % 3 or left % 3))), None)
            if k is None:
                break
            opener = stack[k]
            del stack[k + 1 :]
            n = left if char == "~" else 2 if opener[2] >= 2 and left >= 2 else 1
            opener[2] -= n
            spans.append((opener[0] + opener[2], start + n, n))
            start, left = start + n, left - n
            if not opener[2]:
                stack.pop()
        if opens and left:
            stack.append([start, char, left, opens, closes, left])
    return spans


def table_cells(row: str) -> list[str]:
    """Trimmed cells of a pipe row; an escaped pipe belongs to its cell."""
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [x.strip() for x in re.split(r"(?<!\\)\|", row)]


def compress_table(rows: list[str]) -> str | None:
    """Rows without delimiters, cells by spaces; None if that is not shorter or there are no data rows."""
    header, data = table_cells(rows[0]), [table_cells(x) for x in rows[2:]]
    if not data:
        return None
    lines = [f"{header[0]}:{x[0]}" if len(x) == len(header) == 1 else " ".join(x) for x in data]
    out = "".join(f"{x}\n" for x in ([" ".join(header)] if len(header) > 1 else []) + lines)
    return out if size(out) <= size("\n".join(rows) + "\n") else None


def squeeze_code(content: str) -> str:
    """Without blank lines at the edges, runs of line ends as one."""
    from .code import squeeze_lines, strip_edges

    return squeeze_lines(strip_edges(content))


def apply_structure(text: str, level: Level, mode: CodeMode = CodeMode.COMPRESS) -> str:
    """The text with its decorations dropped (level 1), headings and tables shortened (2), tasks marked (3)."""
    if level < Level.LIGHT:
        return text
    lines, ends = [], []
    for x in text.splitlines(keepends=True) if not re.search("[\v\f\x1c-\x1e\x85\u2028\u2029]", text) else re.findall(r"[^\n]*\n|[^\n]+", text):
        body = x.rstrip("\n")
        lines.append(body)
        ends.append(x[len(body) :])
    out: list[str] = []
    prose: list[str] = []

    def flush() -> None:
        if prose:
            out.append(strip_inline("".join(prose)))
            prose.clear()

    i, n = 0, len(lines)
    if level >= Level.MEDIUM and (m := re.match(r"---\n.*?\n---\n", text, re.S)):  # frontmatter is no thematic break; a later pass drops it
        i = m[0].count("\n")
        out.append(m[0])
    while i < n:
        line = lines[i].rstrip("\r")
        if m := _FENCE.match(line):
            flush()
            tick, j = m[1], i + 1
            if "`" in m[2] and tick[0] == "`":
                prose.append(lines[i] + ends[i])
                i += 1
                continue
            close = re.compile(rf" {{0,3}}{re.escape(tick[0])}{{{len(tick)},}}[ \t]*\r?$")
            while j < n and not close.match(lines[j]):
                j += 1
            body = "".join(a + b for a, b in zip(lines[i + 1 : j], ends[i + 1 : j], strict=True))
            if mode is CodeMode.COMPRESS_WHITESPACE and body:
                body = squeeze_code(body) + ("\n" if j < n else "")
            out.append(lines[i] + ends[i] + body)
            if j < n:
                out.append(lines[j] + ends[j])
            i = j + 1
        elif not prose and _HTML.match(line) or re.match(r" {0,3}<!--", line):
            flush()
            end = next((e for p, e in _RAW_END if p.match(line)), "")
            end = f"</{re.match(r' {0,3}<(\w+)', line)[1]}>" if end is None else end
            j = i
            if end:
                while j < n and end not in lines[j]:
                    j += 1
                if end == "-->" and j < n:  # what follows a comment stays
                    rest = lines[j][lines[j].index(end) + 3 :]
                    if rest.strip():
                        prose.append(rest + ends[j])
            else:
                while j + 1 < n and lines[j + 1].strip():
                    j += 1
            i = j + 1
        elif _RULE.match(line) and not (prose and line.lstrip().startswith("-") and prose[-1].strip() and "-" not in prose[-1][:2] and set(line.strip()) == {"-"} and re.match(r" {0,3}\S", prose[-1])):
            flush()
            i += 1
        elif (m := _HEADING.match(line)) and (m[2] or "").strip():
            flush()
            out.append((m[2].strip().lower() + ":" if level >= Level.MEDIUM else strip_inline(lines[i])) + ends[i])
            i += 1
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and "|" in lines[i + 1] + line and _DELIMITER_ROW.match(lines[i + 1]) and len(table_cells(line)) == len(table_cells(lines[i + 1])):
            flush()
            j = i + 2
            while j < n and lines[j].strip() and ("|" in lines[j]):
                j += 1
            short = compress_table([x.rstrip("\r") for x in lines[i:j]]) if level >= Level.MEDIUM else None
            if short is not None:
                out.append(short if ends[j - 1] else short[:-1])
            else:
                out += [(strip_inline(a) if level < Level.MEDIUM else a) + b for a, b in zip(lines[i:j], ends[i:j], strict=True)]
            i = j
        elif level >= Level.STRUCTURED and (m := _TASK.match(line)):
            flush()
            out.append(f"{m[1]}{'+' if m[2] == 'x' else '!'} {m[3]}{ends[i]}")
            i += 1
        else:
            if not line.strip() or re.match(r"[ \t]*(?:[-*+]|\d+[.)])[ \t]", line) or re.match(r" {0,3}>", line):
                flush()  # marks do not pair across blocks
            if m := re.match(r"([ \t]*(?:[-*+]|\d+[.)])[ \t]+)(.*)", lines[i], re.S):
                out.append(m[1])
                prose.append(m[2] + ends[i])
            else:
                prose.append(lines[i] + ends[i])
            if not line.strip():
                flush()
            i += 1
    flush()
    return "".join(out)
