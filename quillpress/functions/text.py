"""Text operators as built-in expressions: no Python runs where these do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends.
_ENDS = r"(?U)^\s+|\s+$"
# Fixed values, as in the per-text operators.
SCHEMES = ("https://", "http://", "file://", "ftp://")
OPERATORS = ("=", "+", "-", "*", "/", "==", "!=", "<", ">", "<=", ">=", "&&", "||")
LANGUAGES = (("python", "py"), ("bash", "sh"), ("javascript", "js"), ("typescript", "ts"), ("markdown", "md"))
TITLE = r"""^[\p{IsAlphabetic}\p{N}\-_ &,./():;!?'"@#$%+=~`]+$"""


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def lines(text: Column) -> Column:
    """Lines that end at \\n or \\r\\n; no empty line after the last end."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def joined(parts: Column) -> Column:
    """Every line ended by \\n."""
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n"), F.lit("\n"))).when(parts.isNotNull(), F.lit(""))


def strip_schemes(text: Column) -> Column:
    for x in SCHEMES:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def strip_comments(text: Column) -> Column:
    """Without HTML comments, over lines too."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def squeeze_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n+", "\n")


def strip_edges(text: Column) -> Column:
    """Without blank lines at the start and end, and without the last line end."""
    body = F.array_join(lines(text), "\n")
    return F.when(body.rlike(r"\S"), F.regexp_replace(F.regexp_replace(body, r"\A\s*\n", ""), r"\n\s*\z", "")).when(body.isNotNull(), F.lit(""))


def strip_short_comments(text: Column) -> Column:
    return joined(F.filter(lines(text), lambda x: ~(trim(x).rlike(r"^(#|//|--|%|;)") & (F.octet_length(trim(x)) < 20))))


def minify_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, r"([(\[,]) | (?=[)\];}])", "$1")
    for x in OPERATORS:
        text = F.replace(text, F.lit(f" {x} "), F.lit(x))
    return text


def normalized_heading(line: Column) -> Column:
    """`title:` of a # heading, else null."""
    content = F.regexp_extract(line, r"^ {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", 1)
    return F.when(content != "", F.concat(F.lower(content), F.lit(":")))


def heading_title(line: Column) -> Column:
    """The title of `title: text` or `title:`, else null."""
    line = trim(line)
    before, short = F.substring_index(line, ": ", 1), F.substring(line, F.lit(1), F.length(line) - 1)
    return F.when(line.contains(": ") & before.rlike(TITLE), before).when(line.endswith(":") & short.rlike(TITLE), short)


def after_colon(line: Column) -> Column:
    at = F.instr(line, ": ")
    return F.when(at > 0, trim(F.substring(line, at + 2, F.length(line)))).otherwise(F.lit(""))


def checklist(line: Column) -> Column:
    """struct(checked, text) of `+ text` or `! text`, else null."""
    line = trim(line)
    return F.when(line.rlike(r"^[+!] "), F.struct(line.startswith("+").alias("checked"), F.substring(line, F.lit(3), F.length(line)).alias("text")))


def level_3_line(line: Column) -> Column:
    title, content, trimmed = heading_title(line), after_colon(line), trim(line)
    indent = F.when(line.startswith(" "), "  ").otherwise("")
    item = F.regexp_replace(trimmed, r"^(?:- )*(?:\* )*", "")
    return (
        F.when(title.isNotNull(), F.when(content != "", F.concat(title, F.lit(": "), content)).otherwise(F.concat(title, F.lit(":"))))
        .when(trimmed.rlike(r"^[+!] "), F.concat(indent, trimmed))
        .when(line.rlike(r"(?U)^\s*[-*] "), F.concat(indent, F.lit("- "), item))
        .otherwise(line)
    )


def level_3(text: Column) -> Column:
    """Sections as keys, lists and tasks by marker."""
    return joined(F.transform(F.filter(lines(text), lambda x: x != ""), level_3_line))


def shorten_languages(text: Column) -> Column:
    for name, short in LANGUAGES:
        for fence in ("{``````", "{````"):
            text = F.replace(text, F.lit(f"{fence}{name} "), F.lit(f"{fence}{short} "))
    return text


def has_markers(text: Column) -> Column:
    """Whether a line starts with a list or task marker, so that a legend helps."""
    return F.exists(lines(text), lambda x: trim(x).rlike(r"^[-+!] "))


def shorter(new: Column, old: Column, or_equal: bool = False) -> Column:
    """new where it has fewer bytes (or as many), else old."""
    less = F.octet_length(new) <= F.octet_length(old) if or_equal else F.octet_length(new) < F.octet_length(old)
    return F.when(less, new).otherwise(old)


def dict_entries(text: Column) -> Column:
    """MAP of a dictionary header's keys to values."""
    rows = F.filter(lines(text), lambda x: x.rlike(r"^  @[^ ]*.*: "))
    pairs = F.transform(rows, lambda x: F.struct(F.substring_index(trim(x), ": ", 1).alias("k"), F.substring(trim(x), F.instr(trim(x), ": ") + 2, F.length(x)).alias("v")))
    return F.when(text.rlike(r"(?m)^@dict:"), F.map_from_entries(pairs)).otherwise(F.map_from_entries(F.slice(pairs, 1, 0)))


def dict_body(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(r"^(@dict:|  @)")), "\n")


def dict_expand(text: Column) -> Column:
    """The body with its references replaced, the longest keys first."""
    entries = F.transform(F.map_entries(dict_entries(text)), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.aggregate(F.array_sort(entries), dict_body(text), lambda a, e: F.replace(a, e["k"], e["v"]))
