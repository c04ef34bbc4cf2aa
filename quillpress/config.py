"""Settings of the minifier: levels, code modes, grammar levels, and their builder."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from enum import Enum, IntEnum


class Level(IntEnum):
    OFF = 0
    LIGHT = 1
    MEDIUM = 2
    STRUCTURED = 3
    ULTRA = 4

    @classmethod
    def parse(cls, text: str) -> Level:
        names = {x.name.lower(): x for x in cls} | {str(int(x)): x for x in cls} | {"extreme": cls.ULTRA}
        try:
            return names[str(text).strip().lower()]
        except KeyError:
            raise ValueError(f"unknown level {text!r}: 0-4, off, light, medium, structured, ultra or extreme") from None


class CodeMode(Enum):
    PRESERVE = "preserve"
    COMPRESS_WHITESPACE = "compress-whitespace"
    COMPRESS = "compress"

    @classmethod
    def parse(cls, text: str) -> CodeMode:
        try:
            return cls(str(text).strip().lower().replace("_", "-"))
        except ValueError:
            raise ValueError(f"unknown code mode {text!r}: {', '.join(x.value for x in cls)}") from None


class GrammarLevel(Enum):
    LIGHT = "light"
    MEDIUM = "medium"
    AGGRESSIVE = "aggressive"

    @classmethod
    def parse(cls, text: str) -> GrammarLevel:
        given = str(text).strip().lower()
        try:
            return cls({"": "medium", "agg": "aggressive"}.get(given, given))
        except ValueError:
            raise ValueError(f"unknown grammar level {text!r}: light, medium or aggressive") from None

    @property
    def threshold(self) -> float:
        """Words that score this much go.  Fixed values."""
        return {"light": 0.8, "medium": 0.6, "aggressive": 0.4}[self.value]


@dataclass(frozen=True)
class Config:
    level: Level = Level.MEDIUM
    code_blocks: CodeMode = CodeMode.COMPRESS
    legend: bool = True
    grammar: GrammarLevel | None = None
    dictionary: bool = False

    def with_level(self, level: Level) -> Config:
        return replace(self, level=Level(level))

    def with_code_blocks(self, mode: CodeMode) -> Config:
        return replace(self, code_blocks=mode)

    def with_legend(self, legend: bool) -> Config:
        return replace(self, legend=legend)

    def with_grammar_strip(self, level: GrammarLevel = GrammarLevel.MEDIUM) -> Config:
        return replace(self, grammar=level)

    def without_grammar_strip(self) -> Config:
        return replace(self, grammar=None)

    def with_dictionary(self, dictionary: bool = True) -> Config:
        return replace(self, dictionary=dictionary)

    @property
    def is_grammar_strip_enabled(self) -> bool:
        return self.grammar is not None

    @classmethod
    def from_env(cls) -> Config:
        """Defaults from QUILLPRESS_LEVEL and QUILLPRESS_CODE_BLOCKS."""
        own = cls()
        if level := os.environ.get("QUILLPRESS_LEVEL"):
            own = own.with_level(Level.parse(level))
        if mode := os.environ.get("QUILLPRESS_CODE_BLOCKS"):
            own = own.with_code_blocks(CodeMode.parse(mode))
        return own


def grid() -> dict[str, Config]:
    """The 14 settings of the corpus report: five bare levels, and three levels with grammar, dictionary or both."""
    found = {f"L{int(x)}": Config(x) for x in Level}
    for x in (Level.MEDIUM, Level.STRUCTURED, Level.ULTRA):
        found[f"L{int(x)}_g"] = Config(x).with_grammar_strip()
        found[f"L{int(x)}_d"] = Config(x).with_dictionary()
        found[f"L{int(x)}_gd"] = Config(x).with_grammar_strip().with_dictionary()
    return found
