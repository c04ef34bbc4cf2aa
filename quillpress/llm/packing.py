"""Packing token sequences by the histogram of lengths, shortest pack first.

1. Every text is tokenised once and its ids are kept in a table in the shared folder.  A document
   of n ids gives n // capacity full pieces, a sequence each, and a rest of n % capacity ids.
2. The rests' lengths are counted; the histogram has fewer than `capacity` rows at any size of the
   corpus and is all that the driver gets.
3. plan_packing() places the lengths, longest first, into the shortest pack so far.  Packs with
   the same pattern are one run of sequence ids with a count; placing m documents in a run of
   c > m packs splits the run, so the work follows the number of lengths and not of documents.
   The least filled packs, as many as whole sequences could be saved, are then dissolved and
   their documents cut to fill the gaps of the others: less than one sequence of padding is left.
4. The plan says for a length and a range of ranks where its documents go.  A document's rank
   among those of its length is a count kept while tokenising plus the counts of the parts before
   its own, so no length, however common, is gathered or sorted in one place.

Defined results: a null text counts as empty, and an empty text is its end id alone; rows that
repeat an id are packed as rows of their own; extra columns are ignored; an empty table gives an
empty result.  Long texts, runs of white space of any length included, are tokenised whole and cut
into pieces.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_column, materialize, ship

CAPACITY = 2048
END_ID = 1
#: Fixed value: the tokenizer's only special token, which its file also finds inside texts.
SPECIAL = "<|endoftext|>"


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, tuple]], int]:
    """(plan, number of sequences) for counts of lengths below capacity.

    A row of the plan is (length, first rank, count, parts): document first rank + i of that
    length has the parts (start, length, sequence, offset), in sequence + i.
    """
    if any(not 0 < x < capacity or n < 0 for x, n in histogram.items()):
        raise ValueError("lengths must lie between 1 and capacity - 1")
    runs: list[tuple[int, int, int]] = []  # (filled, first pack, packs), shortest pack first
    placed: list[tuple[int, int, int, int, int]] = []  # (length, first rank, count, first pack, offset)
    packs = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if runs and runs[0][0] + length <= capacity:
                filled, first, count = heapq.heappop(runs)
                m = min(count, left)
                if m < count:
                    heapq.heappush(runs, (filled, first + m, count - m))
            else:
                filled, first, m = 0, packs, left
                packs += left
            placed.append((length, rank, m, first, filled))
            heapq.heappush(runs, (filled + length, first, m))
            rank, left = rank + m, left - m

    total = sum(x * n for x, n in histogram.items())
    spare = packs - -(-total // capacity)  # sequences that fuller packs would save
    runs.sort()
    donors, kept = [], []
    for filled, first, count in runs:
        m = min(count, spare)
        spare -= m
        if m:
            donors.append((first, m))
        if count > m:
            kept.append((filled, first + m, count - m))
    kept.sort(key=lambda x: x[1])
    donors.sort()

    # Sequence ids without the dissolved packs.
    bounds, lost = [0], [0]
    for first, m in donors:
        bounds.append(first)
        lost.append(lost[-1] + m)
    renumber = lambda pack: pack - lost[bisect_right(bounds, pack, lo=1) - 1]
    edges = sorted({x for first, m in donors for x in (first, first + m)})
    dissolved = {first for first, _ in donors}
    inside = lambda pack: bool(donors) and (i := bisect_right(bounds, pack, lo=1) - 1) > 0 and pack < donors[i - 1][0] + donors[i - 1][1]

    plan: list[tuple[int, int, int, tuple]] = []
    loose: list[tuple[int, int, int]] = []  # documents of dissolved packs: (length, first rank, count)
    for length, rank, count, first, offset in placed:
        cuts = [first, *(x for x in edges[bisect_right(edges, first) :] if x < first + count), first + count]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a in dissolved or inside(a):
                loose.append((length, rank + a - first, b - a))
            else:
                plan.append((length, rank + a - first, b - a, ((0, length, renumber(a), offset),)))

    # Fill the gaps, the largest first, with loose documents, the longest first.
    gaps = sorted(((filled, renumber(first), count) for filled, first, count in kept if filled < capacity), reverse=True)
    todo = [(length, rank, count, ()) for length, rank, count in sorted(loose)]
    while todo:
        length, rank, count, parts = todo.pop()
        done = sum(x[1] for x in parts)
        filled, first, packs_left = gaps.pop()
        m, size = min(count, packs_left), min(length - done, capacity - filled)
        if count > m:
            todo.append((length, rank + m, count - m, tuple((s, n, q + m, o) for s, n, q, o in parts)))
        if packs_left > m:
            gaps.append((filled, first + m, packs_left - m))
        if filled + size < capacity:
            gaps.append((filled + size, first, m))
        parts = (*parts, (done, size, first, filled))
        if done + size < length:
            todo.append((length, rank, m, parts))
        else:
            plan.append((length, rank, m, parts))
    return plan, packs - sum(m for _, m in donors)


class Encoder:
    """Ids of a byte-level BPE file; the ranks of the same vocabulary give the same ids sooner.

    A text that the quick way refuses (its patterns' stack ends at some 10^6 white-space characters
    in a row) or that holds the special token goes through the file's own tokenizer.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.quick = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is not None and SPECIAL not in text:
            try:
                return np.frombuffer(memoryview(self.quick.encode_to_numpy(text)), np.uint32)
            except ValueError:
                pass
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def public_encoder() -> Encoder:
    import public_tokenizers as p

    return Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def tokenised(docs: DataFrame, id_col: str, text_col: str, capacity: int, encoder=public_encoder, end_id: int = END_ID) -> DataFrame:
    """(part, id, n, rest, local, full, ids): ids as little-endian uint16 where they fit, else uint32.

    local is the row's rank among those of its part with the same rest, full the full pieces of
    those rows before it.  part numbers the tasks that wrote the table.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, ranks, fulls = None, {}, {}
        for batch in batches:
            encode = encode or encoder()
            rows = []
            for data in binary_column(batch, "text"):
                ids = np.append(encode(data.decode("utf-8", "replace") if data else ""), np.uint32(end_id)).astype(np.uint32)
                rest, full = len(ids) % capacity, len(ids) // capacity
                wide = ids.max() > 0xFFFF
                rows.append((len(ids), rest, ranks.get(rest, 0), fulls.get(rest, 0), wide, ids.astype("<u4" if wide else "<u2").tobytes()))
                ranks[rest] = ranks.get(rest, 0) + 1
                fulls[rest] = fulls.get(rest, 0) + full
            n, rest, local, full, wide, ids = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(rest, pa.int32()), pa.array(local, pa.int64()), pa.array(full, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())],
                names=["part", "id", "n", "rest", "local", "full", "wide", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part long, id long, n long, rest int, local long, full long, wide boolean, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, encoder=public_encoder, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, with_ids, the ids (little-endian uint32)."""
    kept = materialize(tokenised(docs, id_col, text_col, capacity, encoder, end_id), "packing-ids")
    counts = kept.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {capacity}")).alias("fulls"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("part", "rest", "rows", "fulls", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("full0")), "packing-counts")
    by_rest = counts.groupBy("rest").agg(F.sum("rows").alias("rows"), F.sum("fulls").alias("fulls")).collect()  # at most `capacity` rows
    plan, sequences = plan_packing({r["rest"]: r["rows"] for r in by_rest if r["rest"]}, capacity)
    full_base, at = np.zeros(capacity, np.int64), sequences
    for r in sorted(by_rest):
        full_base[r["rest"]], at = at, at + r["fulls"]

    plan.sort(key=lambda x: x[:2])
    lengths = np.array([x[0] for x in plan], np.int64)
    firsts = np.array([x[1] for x in plan], np.int64)
    parts = [x[3] for x in plan]
    of_length = np.searchsorted(lengths, np.arange(capacity + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            ids, wide = col["ids"].to_pylist(), col["wide"].to_pylist()
            get = lambda x: col[x].to_numpy(zero_copy_only=False).astype(np.int64)
            n, rest = get("n"), get("rest")
            rank, full = get("rank0") + get("local"), get("full0") + get("full") + full_base[rest]
            who, start, length, seq, offset, crc, piece = [], [], [], [], [], [], []
            for i in range(len(ids)):
                cut = [(j * capacity, capacity, full[i] + j, 0) for j in range(n[i] // capacity)]
                if rest[i]:
                    lo, hi = of_length[rest[i]], of_length[rest[i] + 1]
                    k = lo + int(np.searchsorted(firsts[lo:hi], rank[i], side="right")) - 1
                    base, step = n[i] - rest[i], rank[i] - firsts[k]
                    cut += [(base + s, m, q + step, o) for s, m, q, o in parts[k]]
                tokens = np.frombuffer(ids[i], "<u4" if wide[i] else "<u2").astype("<u4")
                for s, m, q, o in cut:
                    raw = tokens[s : s + m].tobytes()
                    who.append(i), start.append(s), length.append(m), seq.append(q), offset.append(o), crc.append(zlib.crc32(raw)), piece.append(raw if with_ids else None)
            who = pa.array(who, pa.int64())
            longs = lambda x: pa.array(np.array(x, np.int64))
            yield pa.RecordBatch.from_arrays(
                [col["id"].take(who), longs(start), longs(length), col["n"].take(who), longs(seq), longs(offset), longs(crc), pa.array(piece, pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"],
            )

    placed = kept.join(counts.select("part", "rest", "rank0", "full0"), ["part", "rest"])
    return placed.mapInArrow(run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary")
