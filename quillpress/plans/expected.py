"""Documents with traps, as templates of {k} (a number) and {s} (a word), and what the operators make of them.

The results are written down, not computed: each follows from the operators' rules line by line, and tests
hold the operators against them for many values.
"""

from __future__ import annotations

#: Phrases, plurals, negation, an address, words in names, ticks, and a fence that stays open.
PROSE = """\
In order to {k}: in order to update the configuration of {k}, make sure to utilize the specifications.
The {s} service is not the default. It was never a problem, but the users can retry.
See https://example.com/config/{k} and docs.example.com/path/{k} now.
Hardly any of the requests are an error; the others are very quick.
my_config and reconfigure keep the names, a NAME does not.
They don't list the files. An AN stays
`the config` and ```the config``` stay; the config goes.
The rest of the configuration is in code, and the words are not.
"""
#: A full stop makes the word before it an address; `never`, `not` and `hardly` keep words up to the end of their clause.
PROSE_STRIPPED = """\
In order to {k}: to upd config of {k}, ensure use specifications.
{s} svc not the default. never a problem, usrs retry.
See https://example.com/config/{k} docs.example.com/path/{k} now.
Hardly any of the reqs are an err; others quick.
my_config reconfigure keep nms, NAME not.
They don't lst the files. stays
`the config` ````the config```` stay; config goes.
rest of configuration in code, words not.
"""
#: A block and a line that stand twice, short lines that do too, and blocks that begin alike.
REPEATS = """\
# Part {k}
The first line of a block about {k}.
The second line of that block goes on.
The third line ends the block here.
## Next
A single line of more than twenty bytes {k}.
short
note:
short
# Again
The first line of a block about {k}.
The second line of that block goes on.
The third line ends the block here.
A single line of more than twenty bytes {k}.
# Alike
They begin with equal words, one
and end
in another way than
# Too
They begin with equal words, two
or end
as they like, {s}
"""
#: References name the section of the first place; headings, short lines and blocks whose first 20 characters differ stay.
REPEATS_REPLACED = """\
# Part {k}
The first line of a block about {k}.
The second line of that block goes on.
The third line ends the block here.
## Next
A single line of more than twenty bytes {k}.
short
note:
short
# Again
[see §1]
[see §2]
# Alike
They begin with equal words, one
and end
in another way than
# Too
They begin with equal words, two
or end
as they like, {s}
"""
#: A path that stands five times, once in code, and a name that stands four times.
PATHS = """\
open /srv/{s}/ledger/{k}/index.csv first
then /srv/{s}/ledger/{k}/index.csv again
```
/srv/{s}/ledger/{k}/index.csv in code
```
and /srv/{s}/ledger/{k}/index.csv last, /srv/{s}/ledger/{k}/index.csv
one delta.echo.fox{k} two delta.echo.fox{k} three delta.echo.fox{k} four delta.echo.fox{k}
"""
#: What saves more comes first; code stays.
PATHS_CODED = """\
@dict:
  @m1: /srv/{s}/ledger/{k}/index.csv
  @m2: delta.echo.fox{k}
open @m1 first
then @m1 again
```
/srv/{s}/ledger/{k}/index.csv in code
```
and @m1 last, @m1
one @m2 two @m2 three @m2 four @m2
"""
#: A document with all that levels, grammar and dictionary change.
NOTE = """\
---
id: {k}
---
# Harbour {k}

The *quiet* quay of the ~~old~~ {s} town is **really** very wide.<!-- unseen {k} -->

<aside>
nobody reads {k}
</aside>

| boat | berth | crew |
|---|---|---|
| heron | {k} | 4 |
| plover | 12 | {k} |

- Tides
  - spring
  - neap
- [x] moored
- [ ] sailed

***

```python
# count of {k}
x = ( 1 + {k} )  # sum


y = [ 1, 2 ]
```

> A quoted word about {k}.

See [the chart](https://charts.example/harbour/{k}/index.html) in `chart {k}`.

## Log
The first watch of {k} saw a light.
The second watch saw nothing at all.
The third watch slept until dawn came.

## Copy
The first watch of {k} saw a light.
The second watch saw nothing at all.
The third watch slept until dawn came.

Open /srv/harbour/{s}/{k}/log then /srv/harbour/{s}/{k}/log next /srv/harbour/{s}/{k}/log and /srv/harbour/{s}/{k}/log last.
"""
#: Marks, rules, comments and blocks of HTML go; repeated blocks are references.
NOTE_L1 = """\
id: {k}
---
# Harbour {k}

The quiet quay of the old {s} town is really very wide.


| boat | berth | crew |
|---|---|---|
| heron | {k} | 4 |
| plover | 12 | {k} |

- Tides
  - spring
  - neap
- [x] moored
- [ ] sailed


```python
# count of {k}
x = ( 1 + {k} )  # sum


y = [ 1, 2 ]
```

> A quoted word about {k}.

See [the chart](https://charts.example/harbour/{k}/index.html) in `chart {k}`.

## Log
The first watch of {k} saw a light.
The second watch saw nothing at all.
The third watch slept until dawn came.

## Copy
[see §3]
Open /srv/harbour/{s}/{k}/log then /srv/harbour/{s}/{k}/log next /srv/harbour/{s}/{k}/log and /srv/harbour/{s}/{k}/log last.
"""
#: Also frontmatter's rest, headings, tables, nested lists, schemes and code.
NOTE_L2 = """\
harbour {k}:

The quiet quay of the old {s} town is really very wide.


boat berth crew
heron {k} 4
plover 12 {k}

Tides:   spring,   neap
[x] moored
[ ] sailed
```python
x=(1+{k})
y=[1,2]
```

> A quoted word about {k}.

See [the chart](charts.example/harbour/{k}/index.html) in `chart {k}`.

log: The first watch of {k} saw a light.
The second watch saw nothing at all.
The third watch slept until dawn came.

copy: The first watch of {k} saw a light.
[see §1]
Open /srv/harbour/{s}/{k}/log then /srv/harbour/{s}/{k}/log next /srv/harbour/{s}/{k}/log and /srv/harbour/{s}/{k}/log last.
"""
#: Also filler words.
NOTE_L2_G = """\
harbour {k}:

quiet quay of old {s} town wide.


boat berth crew
heron {k} 4
plover 12 {k}

Tides: spring, neap
[x] moored
[ ] sailed
````python
x=(1+{k})
y=[1,2]
````

> quoted word about {k}.

See [chart](charts.example/harbour/{k}/index.html) in `chart {k}`.

log: first watch of {k} saw light.
second watch saw nothing at all.
third watch slept until dawn came.

copy: first watch of {k} saw light.
[see §1]
Open /srv/harbour/{s}/{k}/log then /srv/harbour/{s}/{k}/log next /srv/harbour/{s}/{k}/log /srv/harbour/{s}/{k}/log last.
"""
#: What is no list item any more keeps the blank lines behind it.
NOTE_L3, NOTE_L3_G = (x.replace("[x] moored\n[ ] sailed\n", "+ moored\n! sailed\n\n\n") for x in (NOTE_L2, NOTE_L2_G))
#: With white space in code squeezed.
NOTE_L1_CODE = NOTE_L1.replace("# sum\n\n\ny", "# sum\ny")
#: A heading that grows, as its letters have longer lower cases.
DOTTED = "# İİİİİİ {k}\n\nThe {s} word.\n"


def _dotted(gap: str, rest: str) -> str:
    return "i̇i̇i̇i̇i̇i̇ {k}:" + gap + rest


def coded(text: str, path: str = "/srv/harbour/{s}/{k}/log") -> str:
    """A note with its path in a dictionary."""
    return f"@dict:\n  @m1: {path}\n" + text.replace(path, "@m1")


#: What each setting makes of a note and of a dotted heading; level 4's form is not shorter than level 3's, so that is taken.
GRID: dict[str, tuple[str, str]] = {"L0": (NOTE, DOTTED), "L1": (NOTE_L1, DOTTED)}
for _name, _plain, _bare, _gap in (("L2", NOTE_L2, NOTE_L2_G, "\n\n"), ("L3", NOTE_L3, NOTE_L3_G, "\n"), ("L4", NOTE_L3, NOTE_L3_G, "\n")):
    GRID |= {
        _name: (_plain, _dotted(_gap, "The {s} word.\n")),
        f"{_name}_g": (_bare, _dotted(_gap, "{s} word.\n")),
        f"{_name}_d": (coded(_plain), _dotted(_gap, "The {s} word.\n")),
        f"{_name}_gd": (coded(_bare), _dotted(_gap, "{s} word.\n")),
    }

#: Lines of code, and what is left without comments, by language; code of an unknown language stays.
COMMENTED: dict[str, tuple[str, str]] = {
    "python": ('"""what {s} does"""\nu = "# no {k}"  # yes\ndef f():\n    """inner"""\n    return {k}\n', '\nu = "# no {k}"  \ndef f():\n\n    return {k}\n'),
    "bash": ("#!/bin/sh\necho '#{k}' # say {s}\n", "\necho '#{k}' \n"),
    "java": ('String u = "// {k}"; // {s}\n/* a\n{k} */ int v = {k};\n', 'String u = "// {k}"; \n int v = {k};\n'),
    "rust": ("let v = {k}; // {s}\n", "let v = {k}; // {s}\n"),
    "go": ('u := "/* {k}" // {s}\nv := {k} /* w */\n', 'u := "/* {k}" \nv := {k} \n'),
    "js": ("const u = 'http://{s}'; // {k}\n/* {k} */ f({k})\n", "const u = 'http://{s}'; \n f({k})\n"),
    "ts": ("let u: string = `// {k}`; // {s}\n", "let u: string = `// {k}`; \n"),
}


def sql(template: str, k: str = "k", s: str = "s") -> str:
    """The template as an SQL expression over columns k and s, which are texts."""
    out = "'" + template.replace("'", "''") + "'"
    return "(" + out.replace("{k}", f"' || {k} || '").replace("{s}", f"' || {s} || '") + ")"
