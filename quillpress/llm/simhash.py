"""SimHash near-duplicate groups by anchor-point covering.

Fingerprint: 64 bits, by majority over the XXH64 hashes of word shingles.
Two fingerprints link when they differ in at most two bits.

Covering: the anchors are the codewords of two binary Golay codes, one over bits 0-22 and one
over bits 23-45.  The Golay code is perfect with covering radius 3, so each half of a
fingerprint has exactly one codeword within 3 bits: its home.  If x and y differ in t <= 2 bits,
of which t1 and t2 fall in the two halves, then y is within 3 + t1 and 3 + t2 of x's home.  Each
fingerprint is therefore replicated to every anchor within covering radius plus threshold, the
excess over the radius counted over both halves together (61 anchors on average, 2**24 in all),
and compared there with the fingerprints at home: no link is missed, none needs all pairs.

Within an anchor only a spanning forest of the links is passed on, and equal fingerprints have
been made one row before, so a large group of copies gives a row each and not a row per pair.
The groups are then joined across anchors by large-star and small-star rounds on DataFrames.
Copies are counted with partial sums, and only the join that gives every row its group sees a
fingerprint that a large share of rows has; it is an inner join, which Spark splits where a
fingerprint's rows are many (spark.sql.adaptive.skewJoin, on by default).

Defined results: a null text counts as empty; a text without words has fingerprint zero and
links like any other; rows that repeat an id are separate rows with one component each; a null
id never becomes a component's id unless the group has no other; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, materialize, ship

SEED = 42
SHINGLE = 3
THRESHOLD = 2
RADIUS = 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Above so many comparisons for each row an anchor's rows are looked up by bit masks instead.
MASK_LOOKUP = 20_000


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = data.lower().split()  # both are ASCII only on bytes: A-Z; space and 0x09-0x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, uid, fp) per row of docs; fp is the fingerprint's bits as a signed long, uid a hash of the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"") for x in binary_column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64), pa.int64())], names=["id", "uid", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "id long, uid long, fp long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, text): uid, a hash of the text, tells apart rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("uid"), text.alias("text"))


# ---- the covering code ---------------------------------------------------------------------


def _syndromes() -> list[np.ndarray]:
    """The 11-bit remainder by the generator polynomial of every byte of a 23-bit word; a word's is their sum."""
    tables = []
    for shift in (0, 8, 16):
        out = np.arange(256, dtype=np.int64) << shift
        for bit in range(23, 10, -1):
            out ^= (out >> bit & 1) * (GOLAY << (bit - 11))
        tables.append(out)
    return tables


class Anchors:
    """Codewords near a word: for each remainder, the bit masks that lead to a codeword."""

    def __init__(self, threshold: int = THRESHOLD):
        from itertools import combinations

        words, weights = [], []
        for weight in range(RADIUS + threshold + 1):
            for bits in combinations(range(23), weight):
                words.append(sum(1 << b for b in bits))
                weights.append(weight)
        masks, weights = np.array(words, np.int64), np.array(weights)
        self.tables = _syndromes()
        of = self.syndrome(masks)
        order = np.argsort(of, kind="stable")  # by remainder, then by weight
        self.mask, self.excess = masks[order], np.maximum(weights[order] - RADIUS, 0)
        self.first = np.searchsorted(of[order], np.arange(2049))
        self.threshold = threshold

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        low, middle, high = self.tables
        return low[word & 255] ^ middle[word >> 8 & 255] ^ high[word >> 16]

    def near(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For 23-bit words: the row, the codeword's 12 leading bits, the excess over the radius."""
        s = self.syndrome(word)
        count = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(word)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.first[s][row]
        return row, (word[row] ^ self.mask[at]) >> 11, self.excess[at]

    def cover(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For fingerprints: the row, the anchor, and whether the anchor is its home."""
        low, high = (fp & 0x7FFFFF).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
        r1, a1, e1 = self.near(low)
        r2, a2, e2 = self.near(high)
        n1, n2 = np.bincount(r1, minlength=len(fp)), np.bincount(r2, minlength=len(fp))
        f2 = np.cumsum(n2) - n2
        times = n2[r1]
        left = np.repeat(np.arange(len(r1)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + f2[r1][left]
        total = e1[left] + e2[right]
        keep = total <= self.threshold
        left, right, total = left[keep], right[keep], total[keep]
        return r1[left], a1[left] << 12 | a2[right], total == 0


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = None
    for batch in batches:
        anchors = anchors or Anchors()
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 1024):
            part = fp[at : at + 1024]
            row, anchor, home = anchors.cover(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


# ---- comparison within anchors -------------------------------------------------------------


def components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, for edges a-b; labels: of earlier edges."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (step := labels[labels]).tobytes() != labels.tobytes():
            labels = step
    return labels


def _masks(threshold: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    found = [one]
    for _ in range(threshold - 1):
        found.append(np.unique((found[-1][:, None] | one[None, :]).ravel()))
    return np.unique(np.concatenate(found))


def anchor_forest(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by anchor: the links within each anchor, as a spanning forest of fingerprint pairs."""
    n = len(fp)
    edge = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
    size = last - first
    group = np.repeat(np.arange(len(first)), size)
    labels = np.arange(n)
    homes = np.flatnonzero(home & (size[group] > 1))
    large = size[group[homes]] > MASK_LOOKUP
    for start in np.unique(first[group[homes[large]]]):  # linear in the rows: each one's neighbours are looked up
        stop = last[group[start]]
        order = np.argsort(fp[start:stop])
        known = fp[start:stop][order]
        mine = np.arange(start, stop)[home[start:stop]]
        for mask in _masks(threshold):
            at = np.minimum(np.searchsorted(known, wanted := fp[mine] ^ mask), len(known) - 1)
            hit = known[at] == wanted
            labels = components(n, mine[hit], start + order[at[hit]], labels)
    homes = homes[~large]
    work = np.cumsum(size[group[homes]])
    cuts = np.searchsorted(work, np.arange(0, (work[-1] if len(work) else 0) + 2_000_000, 2_000_000))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        mine = homes[lo:hi]
        times = size[group[mine]]
        left = np.repeat(mine, times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group[mine]], times)
        hit = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= threshold)
        labels = components(n, left[hit], right[hit], labels)
    moved = np.flatnonzero(labels != np.arange(n))
    return fp[moved], fp[labels[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; the last anchor of a batch waits for the next batch."""
    kept: list[tuple[np.ndarray, ...]] = []

    def found(rows):
        a, b = anchor_forest(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
        kept.append(rows)
        if rows[0][0] == rows[0][-1] and kept[0][0][0] == rows[0][0]:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield found(tuple(x[:cut] for x in rows))
        kept = [tuple(x[cut:] for x in rows)]
    if kept:
        yield found(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))


# ---- groups across anchors -----------------------------------------------------------------


def connected(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node in links (u, v): root is the smallest node it can reach.

    Large-star and small-star rounds, each written to the shared folder; a round costs two
    aggregations with partial sums and two joins, and the count of rounds grows with the logarithm
    of the longest chain.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), label)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = materialize(small, label)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s"), F.sum(F.xxhash64("v", "u") % 998_244_353).alias("t")).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, uid (a hash of the text), fp (signed long), root (the group's fingerprint) and component_id (its smallest id) for every row of docs."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    near = nodes.select("fp").mapInArrow(_spread, "anchor int, fp long, home boolean")
    forest = near.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long")
    roots = connected(forest, "simhash-links")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.select("fp", "root").join(low, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("id", "uid", "fp", "root", "component_id")
