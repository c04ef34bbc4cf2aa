"""What holds for any text."""

from hypothesis import assume, given, settings
from hypothesis import strategies as st

from quillpress.config import Config, GrammarLevel, Level
from quillpress.operators import code, dictionary, grammar, lists, restructure, scan
from quillpress.operators.minify import minify_text
from quillpress.operators.textlines import size

PIECES = ["# a title", "**bold** and *em*", "- item", "  - child", "* star, comma", "- [x] done", "| a | b |", "|---|---|", "| 1 | 2 |", "```python", "```", "x = ( 1 )  # c", "---", "title:", "short text", "", "  ", "`tick` and ``two``", "the config of the file is not the same", "see https://example.com/a_b_c", "äöü é 日本語 text", "<!-- c -->", "<div>", "alpha.beta.gamma alpha.beta.gamma alpha.beta.gamma alpha.beta.gamma", "a line that is longer than twenty bytes", "> quote"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("\n".join)
ANY = st.one_of(TEXT, st.text(max_size=200))


@settings(max_examples=200, deadline=None)
@given(ANY, st.sampled_from(list(Level)), st.booleans(), st.booleans())
def test_never_fails(text, level, words, entries):
    config = Config(level, grammar=GrammarLevel.MEDIUM if words else None, dictionary=entries)
    assert isinstance(minify_text(text, config), str)


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_guards(text):
    third = restructure.restructure(text, Config(Level.STRUCTURED))
    assert size(restructure.restructure(text, Config(Level.ULTRA))) <= size(third) <= size(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_dictionary(text):
    assert size(dictionary.compress(text)) <= size(text)
    if (coded := dictionary.compress(text)) != text:
        assert dictionary.expand(coded).strip() == text.strip()


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_idempotent(text):
    assume("\r" not in text)  # a bare \r at the end of a text becomes a line end once \n is added
    for f in (code.strip_edges, code.squeeze_lines, code.strip_short_comments):
        once = f(text)
        assert f(once) == once


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_plain_text_stays(text):
    plain = "".join(c if c not in "*_~`<#|[]-\\>+=" else "x" for c in text)
    assert scan.apply_structure(plain, Level.LIGHT) == plain


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_lines_end(text):
    for f in (lists.flatten_nested, lists.inline_tiny_sections, lists.merge_short_items):
        out = f(text)
        assert out == "" or out.endswith("\n")


WORDS = ["the", "The", "a", "A", "an", "config", "configuration", "in order to", "make sure to", "documents", "my_config", "not", "don't", "never", "hardly", "and", "very", "file.", "a.b", "x:y", "http://a.b/c", "docs.example.com/path", "is", "IT", "it's", "über", "2nd", "errors"]
JOINS = [" ", " ", " ", "  ", ", ", ". ", "; ", "\n", "(", ") ", "! ", " — ", "-", "", "`", " ` ", "``", "```", "\n```py\n", "?\n\n"]
PROSE = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(JOINS)), max_size=30).map(lambda xs: "".join(w + j for w, j in xs))


@settings(max_examples=600, deadline=None)
@given(st.one_of(PROSE, ANY), st.sampled_from(list(GrammarLevel)))
def test_short_ways_equal_the_long_ones(text, level):
    """Lines and texts that take the quicker patterns have the results of the general passes."""
    assert grammar.replace_phrases(text) == grammar._replace_any(text)
    assert grammar.drop_words(text, level.threshold) == grammar._drop_any(text, level.threshold)
