"""License notices: exact places, and fuzzy places within a bound of edits.

A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters.
Exact places are found in the words joined by spaces.  For the fuzzy search a notice of m
characters that may have e edits is split into e + 1 pieces; by the pigeonhole principle at least
one piece stands unchanged in any place within e edits.  Exact search for the pieces locates
candidates, and the regex library's bounded-error matching verifies them in a window of
m + 2e + 2 characters around each, giving the span and its count of edits.  A notice's guard
words, which tell one license from another (a version, "nc"), must stand unchanged.

Defined results: a null text counts as empty; empty texts have no words, no place, empty labels
and score 0; repeated rows give a row each; extra columns are ignored; an empty table gives an
empty result.  Whole texts are searched, in one pass over each, so time follows the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, ship


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int = 0
    guard: tuple[str, ...] = ()


#: The base phrases, of which every exact place counts.
BASE = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
#: What the fuzzy search looks for besides.
FUZZY = (
    Notice("mit", "under the mit license", 2, ("mit",)),
    Notice("apache-2", "apache license version 2", 2, ("2",)),
    Notice("cc-by-nc", "licensed under cc by nc", 2, ("cc", "by", "nc")),
    Notice("gpl-3", "gnu general public license version 3", 3, ("3",)),
    Notice("gpl-2", "gnu general public license version 2", 3, ("2",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4, ()),
    Notice("mpl-2", "mozilla public license version 2", 3, ("2",)),
)

#: A-Z to a-z; other ASCII that is neither letter nor digit to a space; the rest stays.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_CLEAN).split()


def _places(text: bytes, phrase: bytes) -> Iterator[int]:
    at = text.find(phrase)
    while at >= 0:
        yield at
        at = text.find(phrase, at + 1)


class WordIndex:
    """How many spaces stand before places that are asked for in order."""

    def __init__(self, joined: bytes):
        self.joined, self.at, self.spaces = joined, 0, 0

    def before(self, at: int) -> int:
        if at < self.at:
            self.at = self.spaces = 0
        self.spaces += self.joined.count(b" ", self.at, at)
        self.at = at
        return self.spaces


class Scanner:
    def __init__(self, base=BASE, fuzzy=FUZZY):
        import regex

        self.base = [(x.label, f" {x.phrase} ".encode()) for x in base]
        self.fuzzy = []
        for x in fuzzy:
            text, parts = x.phrase.encode(), x.edits + 1
            cuts = [len(text) * i // parts for i in range(parts + 1)]
            seeds = list(dict.fromkeys((text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
            best = regex.compile(rb"(?be)(?<= )(?:" + regex.escape(text) + rb"){e<=%d}(?= )" % x.edits)
            self.fuzzy.append((x, text, seeds, best, [b" " + g.encode() + b" " for g in x.guard]))

    def exact(self, joined: bytes) -> list[tuple[int, str, int]]:
        """(first word, label, count of words) of all base places."""
        found = sorted((at, label, phrase.count(b" ") - 1) for label, phrase in self.base for at in _places(joined, phrase))
        index = WordIndex(joined)
        return [(index.before(at), label, n) for at, label, n in found]

    def near(self, joined: bytes) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice's length) in joined of places within the bound, best of those that overlap, by notice."""
        found = []
        for notice, text, seeds, pattern, guards in self.fuzzy:
            slack, shortest = notice.edits + 1, len(text) - notice.edits
            windows = sorted({(max(0, at - offset - slack), min(len(joined), at - offset + len(text) + slack)) for seed, offset in seeds for at in _places(joined, seed)})
            end = -1  # of the last place; each one found is behind it
            for a, b in windows:
                a = max(a, end - 1)
                if b - a < shortest:
                    continue
                for hit in pattern.finditer(joined, a, b):
                    span = joined[hit.start() - 1 : hit.end() + 1]
                    if all(g in span for g in guards):
                        found.append((hit.start(), hit.end(), notice.label, sum(hit.fuzzy_counts), len(text)))
                        end = hit.end()
        return found

    def scan(self, data: bytes) -> dict:
        words = words_of(data)
        joined = b" " + b" ".join(words) + b" "
        spans, base = [], self.exact(joined)
        for at, label, n in base:
            spans.append({"label": label, "first": at, "last": at + n - 1, "edits": 0, "notice": b" ".join(words[at : at + n]).decode()})
        exact = {(x["label"], x["first"]) for x in spans}
        score, index = 1.0 if spans else 0.0, WordIndex(joined)
        for a, b, label, edits, length in sorted(self.near(joined)):
            first = index.before(a) - 1
            if (label, first) not in exact:
                spans.append({"label": label, "first": first, "last": first + joined.count(b" ", a, b), "edits": edits, "notice": joined[a:b].decode("utf-8", "replace")})
                score = max(score, 1.0 - edits / length)
        return {"n_words": len(words), "base": [(at, label) for at, label, _ in base], "spans": spans, "score": score}


_SPAN = "array<struct<label:string,first:bigint,last:bigint,edits:int,notice:string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, fuzzy=FUZZY) -> DataFrame:
    """id, n_words, base_first (word of each exact place), base_label, spans and score for every row of docs."""
    ship(docs.sparkSession)
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("notice", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, fuzzy)
        for batch in batches:
            found = [scanner.scan(x or b"") for x in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array([[y[0] for y in x["base"]] for x in found], pa.list_(pa.int64())),
                    pa.array([[y[1] for y in x["base"]] for x in found], pa.list_(pa.string())),
                    pa.array([x["spans"] for x in found], pa.list_(span)),
                    pa.array([x["score"] for x in found], pa.float64()),
                ],
                names=["id", "n_words", "base_first", "base_label", "spans", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, base_first array<long>, base_label array<string>, spans {_SPAN}, score double")
