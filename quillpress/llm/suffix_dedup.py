"""Removal of byte strings that occur earlier in the corpus, by longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.  In terms of suffixes: a position's longest previous
factor is at least `length`.  Suffixes that agree in `length` bytes stand together in suffix
order, so the nearest smaller position before or after one, in that run, tells.

One suffix array of a corpus fits no machine, so it is cut where suffixes cannot meet.  In every
string of `length` bytes the k-gram with the least hash is its anchor; equal strings have equal
anchors in equal places, so their suffixes belong to one bucket, that of the anchor's hash.

1. Anchors (hash, document, offset) are computed from whole texts, about one in 35 bytes.  Only
   those whose hash occurs twice go on.  Hashes that a sample of documents shows to be common are
   known to, so they are not shuffled by their hash to be counted: their documents only say that
   they hold one.  The sample decides which way a hash goes, never what is found.
2. Documents whose text is that of a document of smaller id are answered at once.  For the others
   the context of every anchor that goes on, the bytes of the strings that it is anchor of, goes
   to the anchor's bucket.  Contexts that are equal within a batch are one row before they move.
3. In a bucket, the contexts' suffixes are put in suffix order, compared by bytes, and the
   previous smaller positions give what is to be removed, as byte ranges.
4. Ranges are merged per document and applied to its text.

An anchor that occurs more than `hot` times gets no bucket of its own: its strings are dealt by
their own hash instead, so a passage that a third of the corpus shares is spread out.  A text that
more than one row in COPIES is a copy of meets its first place by a broadcast of such texts.

Defined results: a null text counts as empty; texts shorter than `length` lose nothing; a null id
counts as larger than any other; rows that repeat an id and a text are one document and get equal
rows; different texts under one id are compared with other ids and each with itself, not with
each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_column, materialize, ship

LENGTH = 100
GRAM = 32
HOT = 100_000
#: Documents in the sample for common anchors, in how many of them a common one is, and how many are kept at most.
SAMPLE, COMMON, MOST = 16_384, 8, 100_000
#: Texts with more copies than one row in so many are hot; there are fewer than so many of them.
COPIES = 1000
#: The place in a text of no anchor.
NO_PLACE = 1 << 60
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Context rows in one group of buckets.
ROWS_A_GROUP = 50_000
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 24) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            power = np.full(n, base, np.uint64)
            power[0] = 1
            out.append(np.multiply.accumulate(power))
        _POWERS[0] = (out[0], out[1])
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each position on."""
    n = len(data) - k + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[k:] - total[:-k]) * inverse[:n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def anchors(pieces: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first start, last start, hash): anchors of all strings of `length` bytes in each piece, offsets in the piece."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = gram_hashes(data, k)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    count = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), count)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]
    at = (low[start] & _POS).astype(np.int64)
    head = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1)) if len(at) else np.zeros(0, np.int64)
    tail = np.concatenate((head[1:] - 1, [len(at) - 1])) if len(at) else head
    p = piece[head]
    return p, at[head] - first[p], start[head] - first[p], start[tail] - first[p], h[at[head]]


def chunks(texts: list[bytes | None], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) lists of about CHUNK bytes; long texts are cut so that no string is lost or counted twice."""
    rows, offsets, pieces, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text or b"") - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            rows.append(i), offsets.append(at), pieces.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, offsets, pieces
                rows, offsets, pieces, size = [], [], [], 0
    if pieces:
        yield rows, offsets, pieces


def suffix_runs(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start's `length` (8 or more) bytes in suffix order; equal strings have equal ranks."""
    rank = np.zeros(len(start), np.int64)
    words = np.zeros(len(data) - 7, np.uint64)  # the 8 bytes from each position on, as a number
    for j in range(8):
        words = words << np.uint64(8) | data[j : len(data) - 7 + j]
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = words[start + at]
        order = np.lexsort((word, rank))
        r, w = rank[order], word[order]
        step = np.cumsum(np.concatenate(([0], ((r[1:] != r[:-1]) | (w[1:] != w[:-1])).astype(np.int64))))
        rank[order] = step
        if step[-1] == len(step) - 1:
            break
    return rank


def has_earlier(rank: np.ndarray, doc: np.ndarray, uid: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Whether a suffix has a previous smaller position in its run of equal ranks."""
    out = np.zeros(len(rank), bool)
    if not len(rank):
        return out
    order = np.lexsort((offset, uid, doc, rank))
    r, d, u = rank[order], doc[order], uid[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = np.concatenate(([False], (r[1:] == r[:-1]) & (d[1:] == d[:-1]) & (u[1:] == u[:-1])))
    out[order] = (d[lead] < d) | same
    return out


def bucket_ranges(h: np.ndarray, doc: np.ndarray, uid: np.ndarray, offset: np.ndarray, context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): the parts of each row's context, in offsets of its document, that occur earlier in its bucket."""
    n = len(h)
    seen: dict[tuple[int, bytes], int] = {}
    order = np.lexsort((offset, uid, doc))
    whole, single = np.zeros(n, bool), []
    for i in order.tolist():  # equal contexts: the first one stands for all
        j = seen.setdefault((int(h[i]), context[i]), i)
        if j != i and (doc[j] < doc[i] or uid[j] == uid[i]):
            whole[i] = True
        else:
            single.append(i)
    single = np.array(single, np.int64)
    size = np.fromiter(map(len, context), np.int64, n)
    rows, lo, hi = [np.flatnonzero(whole)], [offset[whole]], [(offset + size)[whole]]
    _, inverse, count = np.unique(h[single], return_inverse=True, return_counts=True) if len(single) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    single = single[count[inverse] > 1] if len(single) else single
    single = single[np.argsort(h[single], kind="stable")]
    if len(single):
        group = np.concatenate(([0], np.cumsum(np.diff(h[single].view(np.int64)) != 0)))
        windows = np.cumsum(size[single] - length + 1)
        ends = np.concatenate((np.flatnonzero(np.diff(group)) + 1, [len(single)]))
        at = 0
        while at < len(single):  # whole buckets, up to a bound of suffixes at once
            done = windows[at - 1] if at else 0
            stop = int(ends[max(np.searchsorted(ends, at, side="right"), np.searchsorted(windows[ends - 1], done + 500_000, side="right") - 1)])
            mine = single[at:stop]
            at = stop
            data = np.frombuffer(b"".join([context[i] for i in mine.tolist()]), np.uint8)
            first = np.cumsum(size[mine]) - size[mine]
            per = size[mine] - length + 1
            owner = np.repeat(np.arange(len(mine)), per)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            rank = suffix_runs(data, first[owner] + shift, length)
            hit = has_earlier(rank, doc[mine][owner], uid[mine][owner], offset[mine][owner] + shift)
            owner, shift = owner[hit], shift[hit]
            if len(owner):
                new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(shift) > length)))
                head = np.flatnonzero(new)
                tail = np.concatenate((head[1:] - 1, [len(owner) - 1]))
                row = mine[owner[head]]
                rows.append(row), lo.append(offset[row] + shift[head]), hi.append(offset[row] + shift[tail] + length)
    return np.concatenate(rows), np.concatenate(lo), np.concatenate(hi)


def common_anchors(texts: DataFrame, length: int, k: int, hot: int, sample: int, common: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, whether each seems to occur more than `hot` times, how often all seem to occur) of common anchors."""
    step = max(1, texts.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, pieces in chunks(binary_column(batch, "text"), length):
                h, c = np.unique(anchors(pieces, length, k)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(step)) == 0).select("text").mapInArrow(run, "h long, c long")
    found = some.groupBy("h").agg(F.sum("c").alias("n")).where(F.col("n") >= common).orderBy(F.desc("n"), "h").limit(MOST).collect()
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64) * step
    order = np.argsort(h)
    return h[order], n[order] > hot, int(n.sum())


def _among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted known ones, its place there)."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


def remove_earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, hot: int = HOT, with_text: bool = False, sample: int = SAMPLE, common: int = COMMON) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left) for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    known, often, expected = common_anchors(texts, length, k, hot, sample, common)
    shared = spark.sparkContext.broadcast((known, often))  # MOST hashes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, offsets, pieces in chunks(binary_column(batch, "text"), length):
                p, at, _, _, h = anchors(pieces, length, k)
                rows, offsets = np.array(rows, np.int64), np.array(offsets, np.int64)
                is_common, _ = _among(h, known)
                holders = np.unique(doc[rows[p[is_common]]])
                if len(holders):  # a row each, dealt by the document
                    mixed = (holders.view(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
                    none = pa.nulls(len(holders), pa.list_(pa.struct([("doc", pa.int64()), ("at", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(len(holders), 2)), pa.array(holders), pa.array(np.full(len(holders), NO_PLACE)), none], names=["h", "c", "doc", "at", "more"])
                    h, p, at = h[~is_common], p[~is_common], at[~is_common]
                order = np.argsort(h, kind="stable")
                h, where, place = h[order], doc[rows[p[order]]], (offsets[p] + at)[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else order
                count = np.diff(np.concatenate((first, [len(h)]))) if len(h) else order
                extra = np.ones(len(h), bool)
                extra[first] = False
                more = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(count - 1))).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(where[extra]), pa.array(place[extra])], names=["doc", "at"]),
                )
                more = pa.array([None] * len(first), more.type) if not extra.any() else pc.if_else(pa.array(count > 1), more, pa.scalar(None, more.type))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(count), pa.array(where[first]), pa.array(place[first]), more], names=["h", "c", "doc", "at", "more"])

    # one row for a hash and chunk of text, so a hash that many documents share comes once for each chunk
    spots = texts.select("doc", "text").mapInArrow(find, "h long, c long, doc long, at long, more array<struct<doc:bigint,at:bigint>>")
    twice = spots.withColumn("n", F.sum("c").over(Window.partitionBy("h"))).where("n > 1")
    one = F.array(F.struct("doc", "at"))
    twice = twice.select("n", F.inline(F.when(F.col("more").isNull(), one).otherwise(F.concat(one, "more"))))
    meta = texts.select("id", "doc", F.xxhash64("text").alias("uid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    meta = materialize(meta, "suffix-rows")
    firsts = materialize(meta.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "suffix-copies")
    rows = meta.count()
    hot_texts = firsts.where(F.col("n") * COPIES > rows).select("digest", F.col("first").alias("hot_first"))
    meta = meta.join(F.broadcast(hot_texts), "digest", "left")
    key = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.col("doc").cast("string"))  # no digest, so it meets nothing
    meta = meta.withColumn("key", key).join(firsts.where(F.col("n") * COPIES <= rows).select(F.col("digest").alias("key"), "first"), "key", "left")
    meta = materialize(meta.withColumn("copy", F.col("doc") > F.coalesce("hot_first", "first", "doc")).drop("key", "first", "hot_first"), "suffix-meta")
    spots_of = twice.groupBy("doc").agg(F.collect_set(F.when(F.col("n") > hot, -F.col("at") - 1).otherwise(F.col("at"))).alias("ats"))
    todo = materialize(meta.where(~F.col("copy") & (F.col("n_bytes") >= length)).select("doc", "uid").distinct().join(spots_of, "doc"), "suffix-spots")
    groups = max(64, math.ceil(((todo.agg(F.sum(F.size("ats"))).first()[0] or 0) + expected) / ROWS_A_GROUP))
    keyed = texts.select("doc", F.xxhash64("text").alias("uid"), "text")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, often = shared.value
        for batch in batches:
            col = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            doc, uid = (col[x].to_numpy(zero_copy_only=False) for x in ("doc", "uid"))
            wanted = [np.sort(np.array(x, np.int64)) for x in col["ats"].to_pylist()]
            for rows, offsets, pieces in chunks(binary_column(batch, "text"), length):
                p, at, a, b, h = anchors(pieces, length, k)
                is_common, which = _among(h, known)
                many = is_common & often[which] if len(known) else is_common
                keep, spread = np.zeros(len(p), bool), np.zeros(len(p), bool)
                cut = np.searchsorted(p, np.arange(len(pieces) + 1))
                for i in range(len(pieces)):
                    here = at[cut[i] : cut[i + 1]] + offsets[i]
                    for flag, value in ((keep, here), (spread, -here - 1)):
                        flag[cut[i] : cut[i + 1]] = _among(value, wanted[rows[i]])[0]
                keep |= is_common & ~many
                spread |= many
                row, off = np.array(rows, np.int64)[p], np.array(offsets, np.int64)[p]
                out: dict[tuple[int, bytes, int], tuple[int, int, int]] = {}  # the earliest place of a context
                ranges = []
                for j in np.flatnonzero(keep | spread).tolist():
                    piece, r = pieces[p[j]], row[j]
                    if keep[j]:
                        items = [(int(h[j]), piece[a[j] : b[j] + length], int(off[j] + a[j]))]
                    else:
                        items = [(xxhash.xxh3_64_intdigest(w := piece[s : s + length]), w, int(off[j]) + s) for s in range(a[j], b[j] + 1)]
                    for key, context, start in items:
                        mine = (int(doc[r]), int(uid[r]), start)
                        first = out.setdefault((key, context, 0), mine)
                        if first[0] == mine[0] and first[1] != mine[1]:  # another text of the same id: neither is earlier
                            first = out.setdefault((key, context, mine[1]), mine)
                        if first != mine:
                            later = max(first, mine)
                            ranges.append((*later, later[2] + len(context)))
                            if later == first:
                                out[key, context, 0 if out[key, context, 0] == first else mine[1]] = mine
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([np.int64(np.uint64(x[0] & (1 << 64) - 1).astype(np.int64)) for x in out] + [0] * len(ranges), pa.int64()),
                        *(pa.array([x[i] for x in out.values()] + [x[i] for x in ranges], pa.int64()) for i in range(3)),
                        pa.array([x[1] for x in out] + [None] * len(ranges), pa.binary()),
                        pa.array([None] * len(out) + [x[3] for x in ranges], pa.int64()),
                    ],
                    names=["h", "doc", "uid", "start", "context", "stop"],
                )

    found = keyed.join(todo, ["doc", "uid"]).select("doc", "uid", "text", "ats").mapInArrow(contexts, "h long, doc long, uid long, start long, context binary, stop long")

    def bucket(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc, uid, start = (t.column(x).to_numpy() for x in ("doc", "uid", "start"))
        ready = t.column("context").is_null().to_numpy()
        at = np.flatnonzero(~ready)
        h = t.column("h").to_numpy().view(np.uint64)
        row, lo, hi = bucket_ranges(h[at], doc[at], uid[at], start[at], t.column("context").filter(pa.array(~ready)).to_pylist(), length)
        row = at[row]
        give = np.flatnonzero(ready)
        stop = t.column("stop").to_pandas().fillna(0).to_numpy().astype(np.int64)
        return pa.table({"doc": np.concatenate((doc[row], doc[give])), "uid": np.concatenate((uid[row], uid[give])), "lo": np.concatenate((lo, start[give])), "hi": np.concatenate((hi, stop[give]))})

    dealt = found.withColumn("g", F.when(F.col("context").isNull(), F.pmod(F.xxhash64("doc", "start"), F.lit(groups))).otherwise(F.pmod(F.xxhash64("h"), F.lit(groups))))
    ranges = dealt.groupBy("g").applyInArrow(bucket, "doc long, uid long, lo long, hi long")
    per_doc = ranges.groupBy("doc", "uid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            found = [remove_ranges(text, [(x["lo"], x["hi"]) for x in spans]) for text, spans in zip(binary_column(batch, "text"), col["ranges"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [col["doc"], col["uid"], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()), pa.array([x[2] if with_text else None for x in found], pa.binary())],
                names=["doc", "uid", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    changed = keyed.join(per_doc, ["doc", "uid"])
    changed = changed.select("doc", "uid", "text", "ranges").mapInArrow(cut, "doc long, uid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not with_text:
        changed = changed.drop("kept")
    changed = changed.dropDuplicates(["doc", "uid"])
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    out = meta.join(changed, ["doc", "uid"], "left").select(
        "id",
        "doc",
        "uid",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    if with_text:  # texts that lost nothing are read again
        whole = keyed.select("doc", "uid", F.encode("text", "UTF-8").alias("whole")).dropDuplicates(["doc", "uid"])
        out = out.join(whole, ["doc", "uid"]).withColumn("kept", F.coalesce("kept", "whole")).drop("whole")
    return out.drop("doc", "uid")


def remove_ranges(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    removed, runs, left, at = 0, 0, [], 0
    for lo, hi in sorted(ranges):
        if lo > at or not runs:
            left.append(text[at:lo])
            runs += 1
            at = lo
        if hi > at:
            removed += hi - at
            at = hi
    left.append(text[at:])
    return removed, runs, b"".join(left)
