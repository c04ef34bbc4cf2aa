"""Filler words and long phrases in prose, code and addresses left alone.

Two passes: phrases are replaced by short forms, then words whose score reaches the level's
threshold are dropped unless a negation holds.  Both go from one place of interest to the next by
compiled patterns rather than character by character.  Lines without code ticks take a shorter
way, with the standard library's patterns, wherever its word characters are the same ones.
"""

from __future__ import annotations

import re

import regex

from ..config import GrammarLevel
from ..functions.lexicon import FREQUENCY, NEGATION, PROTECTED, REPLACEMENTS
from .textlines import ALNUM, size

def _trie(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings; it takes the longest that fits."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    options = [re.escape(c) + _trie(rest) for c, rest in heads.items()]
    return f"(?:{'|'.join(options)}){'?' if '' in words else ''}" if len(options) > 1 or "" in words else options[0]


_ADDRESS = rf"[{ALNUM}+\-./:~_]"
_PHRASE = regex.compile(rf"(?<![{ALNUM}_])(?:{'|'.join(map(regex.escape, REPLACEMENTS))})")
#: A tick, a run of address characters with a dot or colon, or a phrase: whatever comes first.
_NEXT = regex.compile(rf"(?P<tick>`)|(?P<address>{_ADDRESS}*[.:]{_ADDRESS}*)|(?P<phrase>{_PHRASE.pattern})")
_RUN = regex.compile(f"{_ADDRESS}*")
_ADDRESS_END = regex.compile(r"[ \"')\]>\n]|\Z")
_LETTER = regex.compile(r"\p{Alphabetic}")
_SCHEME = regex.compile(r"[^:]*:[^/]*/[^/]*/")
_DOMAIN = regex.compile(r"[^:][^:.]*\.[^:/]*/")
_TERMINAL = frozenset(" \"')]>\n,.")


def starts_address(text: str, i: int, end: int) -> bool:
    """Whether a letter at i starts an address; end: of the run of address characters after it."""
    ahead = text[i + 1 : min(end, i + 32)]
    if _SCHEME.match(ahead) or _domain(ahead):
        return True
    n = end - i - 1
    return 4 <= n <= 30 and "." in ahead[1:] and (end == len(text) or text[end] in _TERMINAL)


def _domain(ahead: str) -> bool:
    plain = ahead.partition(":")[0]
    dot = plain.find(".", 1)
    return dot >= 0 and "/" in plain[dot:]


#: Characters on which \\w and the classes above differ: marks, and letters in circles and squares.
_ODD = regex.compile(r"[\p{M}\u24b6-\u24e9\U0001f130-\U0001f189]")
_SENTENCE = r"[^\W\d_]{1,30}\.(?=[ \"')\]>\n]|\Z)"
#: A word with a full stop, which stays, or a phrase.
_PLAIN_NEXT = re.compile(rf"(?<![\w+\-./:~]){_SENTENCE}|(?<!\w){_trie(list(REPLACEMENTS))}")
#: A run of address characters with a dot or colon that is no such word.
_PLAIN_ADDRESS = re.compile(rf"(?<![\w+\-./:~])(?!{_SENTENCE})[\w+\-/~]*[.:]")


def _plain(text: str) -> bool:
    return text.isascii() or not _ODD.search(text)


def _short(m: re.Match) -> str:
    return REPLACEMENTS.get(m[0], m[0])


#: An address that goes on over a tick.
_TICKED_ADDRESS = re.compile(r"[.:][^ \"')\]>\n`]*`")
_TICK = re.compile(r"```[^\n]*|`")


def replace_phrases(text: str) -> str:
    if not _plain(text) or "`" in text and _TICKED_ADDRESS.search(text):
        return _replace_any(text)
    if "`" not in text:
        return _replace_plain(text)
    out: list[str] = []
    code = tick = False
    at = 0
    for m in _TICK.finditer(text):
        if code and len(m[0]) == 1:
            continue  # single ticks mean nothing in code
        out.append(text[at : m.start()] if code or tick else _replace_plain(text[at : m.start()]))
        out.append(m[0])
        at = m.end()
        if len(m[0]) > 1:
            code = not code
        else:
            tick = not tick
    out.append(text[at:] if code or tick else _replace_plain(text[at:]))
    return "".join(out)


def _replace_plain(text: str) -> str:
    """Prose without ticks."""
    if not _PLAIN_ADDRESS.search(text):
        return _PLAIN_NEXT.sub(_short, text)
    # neither an address nor a phrase goes over a line's end
    return "\n".join([_replace_any(x) if _PLAIN_ADDRESS.search(x) else _PLAIN_NEXT.sub(_short, x) for x in text.split("\n")])


def _replace_any(text: str) -> str:
    out: list[str] = []
    i, n = 0, len(text)
    code = tick = False
    while i < n:
        if code or tick:
            j = text.find("`", i)
            j = n if j < 0 else j
            out.append(text[i:j])
            i = j
            if i == n:
                break
        if text[i] == "`":
            if text.startswith("```", i):
                code = not code
                j = text.find("\n", i + 3)  # the rest of the fence's line stays
                j = n if j < 0 else j
                out.append(text[i:j])
                i = j
            else:
                tick ^= not code
                out.append("`")
                i += 1
            continue
        m = _NEXT.search(text, i)
        if m is None:
            out.append(text[i:])
            break
        out.append(text[i : m.start()])
        i = m.start()
        if m["phrase"] is not None:
            out.append(REPLACEMENTS[m["phrase"]])
            i = m.end()
        elif m["address"] is not None:
            i = _address(text, i, out)
    return "".join(out)


def _address(text: str, i: int, out: list[str]) -> int:
    """Go through a run that may hold an address; the place after what was taken."""
    end = _RUN.match(text, i).end()
    while i < end:
        if _LETTER.match(text[i]) and starts_address(text, i, end):
            stop = _ADDRESS_END.search(text, i + 1).start()
            out.append(text[i:stop])
            return stop
        if m := _PHRASE.match(text, i):
            out.append(REPLACEMENTS[m[0]])
            return m.end()
        out.append(text[i])
        i += 1
    return i


_TOKEN = regex.compile(rf"``|`|[{ALNUM}'_\-]+|[^`{ALNUM}'_\-]", regex.S)
_CLAUSE_END, _SENTENCE_END = frozenset(",;:—()"), frozenset(".!?")
_UPPER = regex.compile(r"\p{Uppercase}")


def score(word: str, sentence_start: bool) -> float:
    """How freely a word can go: frequency, shortness and place."""
    lower = word.lower()
    if lower in PROTECTED:
        return 0.0
    return FREQUENCY.get(lower, 0.0) + 0.3 * (size(word) <= 3 and not _UPPER.match(word)) - 0.5 * sentence_start


_PLAIN_WORD = re.compile(r"([\w'-]+)")
_KEEP, _NEGATES = -1.0, -2.0
#: What is known of a word as it is written: its score within a sentence, _KEEP or _NEGATES.
_KNOWN: dict[str, float] = {}


def _know(word: str) -> float:
    lower = word.lower()
    value = _NEGATES if lower in NEGATION else _KEEP if lower in PROTECTED or lower not in FREQUENCY else score(word, False)
    if len(_KNOWN) < 1_000_000:
        _KNOWN[word] = value
    return value


def drop_words(text: str, threshold: float) -> str:
    if not _plain(text):
        return _drop_any(text, threshold)
    out: list[str] = []
    state, word = (False, True), ""
    code = tick = False
    pieces = _PAIR.split(text)  # prose or code, ticks, prose or code, ...
    for i in range(0, len(pieces), 2):
        if code or tick:
            out.append(pieces[i])
        else:  # a word goes on behind code that stands in it
            state, word = _drop_plain(word + pieces[i], threshold, state, out, i + 1 == len(pieces))
        if i + 1 < len(pieces):
            pair = len(pieces[i + 1]) > 1
            out.append("```" if pair else "`")
            code, tick = code ^ pair, tick ^ (not pair)
    if word:  # the text ends in code
        parts: list[str] = []
        _drop_plain(word, threshold, state, parts, True)
        out += parts
    done = "".join(out)
    return re.sub(" +", " ", done) if "  " in done else done


_PAIR = re.compile("(``|`)")


def _drop_plain(text: str, threshold: float, state: tuple[bool, bool], out: list[str], last: bool) -> tuple[tuple[bool, bool], str]:
    """Prose without ticks, to out; the state (negated, sentence start) after it and, unless it is the last, a word that it ends in."""
    parts = _PLAIN_WORD.split(text)  # what lies between words, words
    rest = ""
    if not last and len(parts) > 1 and not parts[-1]:
        rest = parts[-2]
        del parts[-2:]
    known = _KNOWN
    negated, start = state
    for i in range(1, len(parts), 2):
        after = parts[i + 1]
        value = known.get(parts[i])
        if value is None:
            value = _know(parts[i])
        if value == _KEEP and after[:1] == " ":
            start = False
            continue
        if value == _NEGATES and after:
            negated, start = True, False
            continue
        mark = after[:1]
        if mark in _CLAUSE_END or mark in _SENTENCE_END:
            negated = False
            start = start or mark in _SENTENCE_END
        if value != _KEEP and value != _NEGATES and not negated and value - 0.5 * start >= threshold:
            parts[i] = ""
            if mark == " ":
                parts[i + 1] = after[1:]
        else:
            start = False
    out.append("".join(parts))
    return (negated, start), rest


def _drop_any(text: str, threshold: float) -> str:
    out: list[str] = []
    word = ""
    code = tick = negated = False
    start = True
    i, n = 0, len(text)
    while i < n:
        m = _TOKEN.match(text, i)
        token = m[0]
        i = m.end()
        if token == "``":
            code = not code
            out.append("```")
        elif token == "`":
            tick = not tick
            out.append("`")
        elif code or tick:
            j = text.find("`", i)
            j = n if j < 0 else j
            out.append(token + text[i:j])
            i = j
        elif len(token) > 1 or _WORD.match(token):
            word += token  # a word goes on behind code that stands in it
        else:
            if word:
                if word.lower() in NEGATION:
                    negated, start = True, False
                    out.append(word + token)
                    word = ""
                    continue
                if token in _CLAUSE_END or token in _SENTENCE_END:
                    negated = False
                    start = start or token in _SENTENCE_END
                gone = not negated and score(word, start) >= threshold
                if not gone:
                    out.append(word)
                    start = False
                word = ""
                if gone and token == " ":
                    continue
            out.append(token)
    if word and (negated or score(word, start) < threshold):
        out.append(word)
    return regex.sub(" +", " ", "".join(out))


_WORD = regex.compile(rf"[{ALNUM}'_\-]")


def strip_grammar(text: str, level: GrammarLevel = GrammarLevel.MEDIUM) -> str:
    """Both passes; no language is detected, as every text is treated alike."""
    return drop_words(replace_phrases(text), level.threshold)
