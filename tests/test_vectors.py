"""Inputs with known outputs, operator by operator."""

import pytest

from quillpress.config import CodeMode, Config, GrammarLevel, Level, grid
from quillpress.functions.lexicon import FREQUENCY, NEGATION, PROTECTED, REPLACEMENTS
from quillpress.operators import code, dedup, dictionary, grammar, lists, restructure, scan
from quillpress.operators.minify import minify_text

L, M, A = GrammarLevel.LIGHT, GrammarLevel.MEDIUM, GrammarLevel.AGGRESSIVE


def test_tables():
    assert (len(FREQUENCY), len(PROTECTED), len(NEGATION), len(REPLACEMENTS)) == (110, 33, 14, 212)
    assert (FREQUENCY["also"], FREQUENCY["pretty"], FREQUENCY["such"]) == (0.7, 0.5, 0.6)
    assert REPLACEMENTS["documents"] == "docs" and REPLACEMENTS["processes"] == "procs"


@pytest.mark.parametrize(
    ("text", "light", "medium", "aggressive"),
    [
        ("our parser must read the header", "our parser must read hdr", "our parser must read hdr", "parser must read hdr"),
        ("that was really quite an odd report", "that really quite odd report", "that odd report", "that odd report"),
        ("make sure to update the schema", "ensure upd sch", "ensure upd sch", "ensure upd sch"),
        ("a server can never drop the queue", "a srv never drop the queue", "srv never drop the queue", "srv never drop the queue"),
        ("scarcely any sockets stay open", "scarcely any sockets stay open", "scarcely any sockets stay open", "scarcely any sockets stay open"),
        ("never that. the rest goes on", "never that. rest goes on", "never that. rest goes on", "never that. rest goes on"),
        ("Moreover our tests pass", "Moreover tests pass", "Moreover tests pass", "Moreover tests pass"),
        ("they didn't want these colours", "they didn't want these colours", "they didn't want colours", "they didn't want colours"),
        ("check the repository. It was there", "check repository. there", "check repository. ", "check repository. "),
        ("these tools rename paths and textures.", "these tls rename pths textures.", "these tls rename pths textures.", "these tls rename pths textures."),
        ("b ```sh\ny = an\n``` c", "b ````sh\ny = an\n```` c", "b ````sh\ny = an\n```` c", "b ````sh\ny = an\n```` c"),
        ("bar`an egg` qux or", "`an egg`bar qux ", "`an egg`bar qux ", "`an egg`bar qux "),
        ("say never. An end of it all", "say never. An end of it all", "say never. An end of it all", "say never. An end of it all"),
        ("an an update", "an upd", "upd", "upd"),
        ("code ``an y`` an", "cod ```an y``` ", "cod ```an y``` ", "cod ```an y``` "),
    ],
)
def test_grammar(text, light, medium, aggressive):
    assert [grammar.strip_grammar(text, x) for x in (L, M, A)] == [light, medium, aggressive]


def test_addresses_stay():
    for text in ("go to https://quay.example/config/file now", "go to quay.example.org/file/path now", "open config.file, now"):
        assert grammar.replace_phrases(text) == text
    assert grammar.replace_phrases("config file") == "cfg fl"
    assert grammar.replace_phrases("my_config") == "my_config"


@pytest.mark.parametrize(
    ("function", "text", "out"),
    [
        (lists.flatten_nested, "- Root\n  - Leaf1\n  - Leaf2\n", "Root:   Leaf1,   Leaf2\n"),
        (lists.flatten_nested, "- p\n- q\n\nwords\n", "p\nq\nwords\n"),
        (lists.flatten_nested, "- Trees\n  - Conifers\n    - Larch\n    - Cedar\n  - Broadleaf\n- Moss\n", "Trees:   Conifers:     Larch,     Cedar,   Broadleaf\nMoss\n"),
        (lists.flatten_nested, "- p\n    - far in\n", "p\n    - far in\n"),
        (lists.flatten_nested, "", ""),
        (lists.inline_tiny_sections, "aim:\nShip it soon.\nthen:\n\ngone\nk:\n```py\na:\nb\n```\n", "aim: Ship it soon.\nthen:\n\ngone\nk: ```py\na: b\n```\n"),
        (lists.merge_short_items, "  - p\n  - q\n  - r, s\n  - t\n- u\n* v\n", "  - p, q\n  - r, s\n  - t\n- u, v\n"),
        (code.minify_spaces, "g( u, v ) { yield u - v ; } p!=q || r [ 3, 4 ]", "g(u,v) { yield u-v;} p!=q||r [3,4]"),
        (code.minify_spaces, "t = \"u , v + w\"", "t=\"u ,v+w\""),
        (restructure.level_3, "p: q\n\n+ m\n  ! n\n  - o\n- kind: z\n", "p: q\n+ m\n  ! n\n  - o\n- kind: z\n"),
        (restructure.level_4, "keys:\n  rsa\n  ed25519\n", "keys{rsa ed25519}\n"),
        (restructure.level_4, "+ Paint\n! Sand\n", "+Paint !Sand\n"),
        (restructure.level_4, "start\n- p\n- q\nhead: uno\ndos\nbare:\n", "start\n-p -q\nhead{uno dos}\nbare{}\n"),
        (restructure.level_4, "- kind: z\nafter\n", "- kind{z after}\n"),
        (dictionary.compress, "open /srv/quarry/ledgers/north/index.csv then /srv/quarry/ledgers/north/index.csv next /srv/quarry/ledgers/north/index.csv last /srv/quarry/ledgers/north/index.csv", "@dict:\n  @m1: /srv/quarry/ledgers/north/index.csv\nopen @m1 then @m1 next @m1 last @m1"),
        (dictionary.compress, "grey herons wade at dawn. grey herons wade at noon. grey herons wade far out. grey herons wade alone.", "@dict:\n  @m1: grey herons wade\n@m1 at dawn. @m1 at noon. @m1 far out. @m1 alone."),
        (dictionary.compress, "delta.echo.fox p delta.echo.fox q delta.echo.fox r delta.echo.fox", "@dict:\n  @m1: delta.echo.fox\n@m1 p @m1 q @m1 r @m1"),
        (dictionary.compress, "", ""),
        (dictionary.compress, "a single place", "a single place"),
    ],
)
def test_operators(function, text, out):
    assert function(text) == out


@pytest.mark.parametrize(
    ("text", "level", "out"),
    [
        ("# Ferry\n\nIt is **late** again.\n", 0, "# Ferry\n\nIt is **late** again.\n"),
        ("**loud**", 1, "loud"),
        ("*tilted*", 1, "tilted"),
        ("~~gone~~ _em_ __st__", 1, "gone em st"),
        ("snake_case_name and 2*3*4", 1, "snake_case_name and 23*4".replace("23*4", "234")),
        ("up<!-- unseen -->down", 1, "updown"),
        ("p `**q**` r", 1, "p `**q**` r"),
        ("<aside>\nnote\n</aside>\n\nrest\n", 1, "\nrest\n"),
        ("a\n\n***\n\nb\n", 1, "a\n\n\nb\n"),
        ("**a *b* c**", 1, "a *b* c"),
        ("## Timetable\n\nBoats **y**.\n", 2, "timetable:\n\nBoats y.\n"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n", 2, "a b\n1 2\n"),
        ("| a |\n|---|\n| 1 |\n| 2 |\n", 2, "a:1\na:2\n"),
        ("- [x] Paint\n- [ ] Sand\n", 3, "+ Paint\n! Sand\n"),
    ],
)
def test_structure(text, level, out):
    assert scan.apply_structure(text, Level(level)) == out


def test_code_modes():
    text = "```go\n\nfunc f() {\n\n\n  n := 2\n}\n\n```\n"
    assert scan.apply_structure(text, Level.LIGHT, CodeMode.PRESERVE) == text
    assert scan.apply_structure(text, Level.LIGHT, CodeMode.COMPRESS) == text
    assert scan.apply_structure(text, Level.LIGHT, CodeMode.COMPRESS_WHITESPACE) == "```go\nfunc f() {\n  n := 2\n}\n```\n"


def test_comments():
    assert code.strip_comments('x = "# no"  # yes\ny = 1\n', "python") == 'x = "# no"  \ny = 1\n'
    assert '"""doc"""' not in code.strip_comments('def f():\n    """doc"""\n    return 1\n', "py")
    assert code.strip_comments('x = """keep"""\n', "python") == 'x = """keep"""\n'
    assert code.strip_comments('let u = "http://x"; // c\n', "js") == 'let u = "http://x"; \n'
    assert code.strip_comments("a /* b\nc */ d\n", "java") == "a  d\n"
    assert code.strip_comments('echo "#x" # y\n', "bash") == 'echo "#x" \n'
    assert code.strip_comments("# keep\n", "cobol") == "# keep\n"


def test_repeats():
    block = "Low water comes at ten past six in the morning.\nThe gate opens an hour after that.\nBoats wait by the wall.\n"
    text = f"# One\n{block}\n# Two\n{block}"
    assert dedup.deduplicate(text) == f"# One\n{block}\n# Two\n[see §1]\n"
    assert dedup.deduplicate("a\nb\n") == "a\nb\n"
    line = "a single line of more than twenty bytes"
    assert dedup.deduplicate(f"t:\n{line}\nb\nc\n{line}\nd\n") == f"t:\n{line}\nb\nc\n[see §1]\nd\n"


def test_dictionary_round_trip():
    text = "see alpha.beta.gamma here\nalpha.beta.gamma there\nand alpha.beta.gamma\nor alpha.beta.gamma\n"
    coded = dictionary.compress(text)
    assert coded != text and dictionary.expand(coded) == text.rstrip("\n")
    assert dictionary.parse(coded) == {"@m1": "alpha.beta.gamma"}
    assert dictionary.strip_header(coded).startswith("see @m1")


def test_whole_settings():
    assert minify_text("", Config(Level.ULTRA).with_grammar_strip().with_dictionary()) == ""
    assert minify_text("the config", Config(Level.OFF)) == "the config"
    assert minify_text("the config", Config(Level.OFF).with_grammar_strip()) == "cfg"
    assert minify_text("## Timetable\n\nBoats leave.\n", Config(Level.MEDIUM)).startswith("timetable:")
    assert "harbour{" in minify_text("# Harbour\n\nWhat is said here takes a line, and more.\n", Config(Level.ULTRA))
    assert minify_text("---\na: 1\n---\nText\n", Config(Level.MEDIUM)) == "Text\n"
    third = minify_text("- [x] Paint\n- [ ] Sand\n", Config(Level.STRUCTURED, legend=False))
    assert "+ Paint" in third and "! Sand" in third and "[x]" not in third
    assert len(grid()) == 14


def test_config():
    assert Level.parse("extreme") is Level.ULTRA and Level.parse("3") is Level.STRUCTURED
    assert GrammarLevel.parse("") is M and GrammarLevel.parse("agg") is A and A.threshold == 0.4
    assert CodeMode.parse("compress-whitespace") is CodeMode.COMPRESS_WHITESPACE
    for parse in (Level.parse, GrammarLevel.parse, CodeMode.parse):
        with pytest.raises(ValueError):
            parse("nonsense")
    config = Config().with_level(Level.LIGHT).with_grammar_strip(L).with_dictionary().with_legend(False)
    assert config.is_grammar_strip_enabled and not config.without_grammar_strip().is_grammar_strip_enabled
