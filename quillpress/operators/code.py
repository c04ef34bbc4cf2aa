"""Fenced code: comments, blank lines, indentation and spaces that carry no meaning."""

from __future__ import annotations

import re

from .textlines import join_lines, size, split_lines

# Language names by the way in which they write comments.
FAMILIES = {
    "python": ("python", "py"),
    "shell": ("bash", "sh", "shell", "zsh"),
    "c": ("javascript", "js", "jsx", "typescript", "ts", "tsx", "go", "golang", "java"),
}
_FAMILY = {name: family for family, names in FAMILIES.items() for name in names}

_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)' + r"|'''(?:\\.|[^\\])*?(?:'''|\Z)"
_SINGLE = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_LEXER = {
    "python": re.compile(rf"(?P<comment>#[^\n]*)|(?P<string>[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_SINGLE}))", re.S),
    "shell": re.compile(r"(?P<comment>(?:(?<=[\s;|&()])|\A)#[^\n]*)|(?P<string>\\.|\$\{[^}\n]*\}|\"(?:\\.|[^\"\\])*\"?|'[^']*'?)", re.S),
    "c": re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`(?:\\.|[^`\\])*`?|" + _SINGLE + r"|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[[^\]\n]*\]|[^/\\\n\[])+/)", re.S),
}


def strip_comments(code: str, language: str) -> str:
    """Without comments and, in Python, without statements that are only a string; unknown languages stay."""
    family = _FAMILY.get(language)
    if family is None:
        return code
    cuts = []
    for m in _LEXER[family].finditer(code):
        if m["comment"] is not None:
            cuts.append(m.span())
        elif family == "python":
            before, after = code[: m.start()].rpartition("\n")[2], code[m.end() :].partition("\n")[0]
            if not before.strip() and re.match(r"\s*(?:#|;|$)", after) and not _continues(code[: m.start()]):
                cuts.append(m.span())
    if not cuts:
        return code
    parts, at = [], 0
    for s, e in cuts:
        parts.append(code[at:s])
        at = e
    lines, out = split_lines("".join([*parts, code[at:]])), []
    for line in lines:
        if line.strip():
            out.append(line)
        elif not out or out[-1]:
            out.append("")
    return join_lines(out)


def _continues(before: str) -> bool:
    """Whether a bracket is open or the line before goes on."""
    plain = re.sub(rf"{_TRIPLE}|{_SINGLE}|#[^\n]*", "", before, flags=re.S)
    return sum(plain.count(x) for x in "([{") > sum(plain.count(x) for x in ")]}") or before.rstrip(" \t\n").endswith(("\\", "=", ",", "+", "("))


def strip_short_comments(code: str) -> str:
    """Without lines that are a comment of fewer than 20 bytes."""
    return join_lines([x for x in split_lines(code) if not (x.strip().startswith(("#", "//", "--", "%", ";")) and size(x.strip()) < 20)])


def strip_edges(text: str) -> str:
    """Without blank lines at the start and end, and without the last line end."""
    lines = split_lines(text)
    if not lines:
        return text
    full = [i for i, x in enumerate(lines) if x.strip()]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


def squeeze_lines(text: str) -> str:
    return re.sub("\n+", "\n", text)


# Operators whose spaces go, in this order.
OPERATORS = ("=", "+", "-", "*", "/", "==", "!=", "<", ">", "<=", ">=", "&&", "||")
_BRACKET_SPACE = re.compile(r"([(\[,]) | (?=[)\];}])")


def minify_spaces(code: str) -> str:
    """Without a space inside brackets, after commas and around operators."""
    code = _BRACKET_SPACE.sub(lambda m: m[1] or "", code)
    for x in OPERATORS:
        code = code.replace(f" {x} ", x)
    return code


def compress_code(code: str, language: str) -> str:
    """All that a code block's content goes through."""
    lines = split_lines(squeeze_lines(strip_edges(strip_comments(strip_short_comments(code), language))))
    indent = min((size(x) - size(x.lstrip()) for x in lines if x.strip()), default=0)
    cut = lambda x: x.encode()[indent:].decode("utf-8", "ignore") if size(x) > indent else x
    return minify_spaces(join_lines([cut(x).rstrip() if x.strip() else "" for x in lines]))


def compress_blocks(text: str) -> str:
    """The text with every block between lines that start with ``` compressed; one that is not closed stays."""
    out: list[str] = []
    block: list[str] | None = None
    language = ""
    for line in split_lines(text):
        if not line.startswith("```"):
            (out if block is None else block).append(line + "\n")
        elif block is None:
            block, language = [], line.lstrip("`").strip()
            out.append(line + "\n")
        else:
            out += [compress_code("".join(block), language), line + "\n"]
            block = None
    return "".join(out + (block or []))
