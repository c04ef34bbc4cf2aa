"""Groups of texts that share most of their five-word shingles: an exact set-similarity join.

Two texts link when the Jaccard similarity of their shingle sets is at least the threshold.

Prefix filter: in any fixed order of all shingles, two sets of similarity t share one of their
first n - ceil(t n) + 1, so only sets that meet in such a prefix are compared, and no link is
missed.  The order puts shingles last that a sample of texts shows to be common; the sample
decides how much is compared, never what is found.

At the first shingle that two sets share in the order, what stands before it in either is not
shared, so their overlap is at most what is left of the shorter rest; pairs for which that cannot be
enough are dropped at a shingle (the position filter).  Copies with many edits of their own, whose
new shingles come first, so meet nobody at the shingles of their original.

Equal sets are one node.  A set travels with a 128-bit SimHash fingerprint of its shingles: sets of
at least WIDE shingles that differ in more than FAR of its bits are not compared.  A link's bits
differ in some 22 on average and in more than FAR with a probability below 1e-6, unrelated sets
in 64 on average.  Every other pair is decided on the two whole sets.

Where few sets meet at a shingle all pairs go on; where many do, each first goes with the hub of
its class of sizes, the set nearest the bitwise majority of their fingerprints (of edited copies
that is their original), and then only pairs that these links leave in different groups do.

Defined results: words are split and lower-cased as for the fingerprint; a text of fewer words
than a shingle is one shingle; null and wordless texts have the empty set and are one group; rows
that share an id are told apart by a hash of their text, and rows without an id take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, materialize, ship, tidy
from .simhash import connected, keyed

SHINGLE = 5
THRESHOLD = 0.8
#: Up to so many sets at a shingle are compared pair by pair at once.
FEW = 8
#: Bits in which the fingerprints of sets of at least WIDE shingles may differ.
FAR, WIDE = 44, 32
#: Texts in the sample that orders the shingles, and in how many of them a common one is.
SAMPLE, COMMON = 4096, 6


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    import xxhash

    words = data.lower().split()
    size = min(shingle, len(words))
    if not size:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(out)]
    out = (out ^ out >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(out ^ out >> np.uint64(33))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes())


def sketch(found: np.ndarray) -> tuple[int, int]:
    """The two halves of the 128-bit SimHash of a set, each as a signed long."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(found), 1 << 14):
        part = found[at : at + (1 << 14)]
        wide = np.stack((part, (part ^ part >> np.uint64(31)) * np.uint64(0xC4CEB9FE1A85EC53)), 1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(found)).view(np.int64).tolist())


def prefix(found: np.ndarray, common: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The first shingles in the order: those not in common (sorted) come first."""
    if not len(found):
        return found
    keep = len(found) - int(np.ceil(threshold * len(found) - 1e-9)) + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate((found[~last], found[last]))
    return found[:keep]


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """At most 100,000 shingles that several texts of a sample by the texts' hash share."""
    step = max(1, docs.count() // SAMPLE)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in binary_column(batch, "text"):
                yield pa.RecordBatch.from_arrays([_signed(shingles(x or b"", shingle))], names=["token"])

    some = docs.where(F.pmod(F.col("uid"), F.lit(step)) == 0).mapInArrow(run, "token long")
    found = some.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(100_000).select("token").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _grouped(batches: Iterator[pa.RecordBatch], step: Callable) -> Iterator[pa.RecordBatch]:
    """step() over columns sorted by the first; the last group of a batch waits for the next batch."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept.append(rows)
        if rows[0][0] == rows[0][-1] and kept[0][0][0] == rows[0][0]:
            continue
        rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from step(*(x[:cut] for x in rows))
        kept = [[x[cut:] for x in rows]]
    if kept:
        yield from step(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _starts(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(token)) + 1
    first = np.concatenate(([0], edge)) if len(token) else np.empty(0, np.int64)
    return first, np.diff(np.concatenate((first, [len(token)])))


def _alike(n: np.ndarray, pos: np.ndarray, f1: np.ndarray, f2: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs left-right of rows that meet at a shingle, at places pos of their order, are worth a comparison of the whole sets."""
    low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    rest = np.minimum(n[left] - pos[left], n[right] - pos[right])
    keep = (low >= threshold * high - 1e-9) & (rest >= threshold / (1 + threshold) * (low + high) - 1e-9)
    bits = lambda f: np.bitwise_count((f[left] ^ f[right]).view(np.uint64)).astype(np.int64)
    far = bits(f1) + bits(f2)
    return keep & ((far <= FAR) | (low < WIDE))


def _hub(f1: np.ndarray, f2: np.ndarray) -> int:
    """The row nearest the bitwise majority of all."""
    bits = np.unpackbits(np.stack((f1, f2), 1).view(np.uint8), axis=1)
    middle = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int((bits != middle).sum(axis=1).argmin())


def _meet(threshold: float) -> Callable:
    """Pairs to compare as (a, b, -1), and the rows of shingles where many sets meet as (node, token, n), with fingerprints."""

    def step(token, node, n, pos, f1, f2):
        first, size = _starts(token)
        group = np.repeat(np.arange(len(first)), size)
        mine = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
        times = size[group[mine]]
        left = np.repeat(mine, times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group[mine]], times)
        keep = left < right
        lefts, rights = [left[keep]], [right[keep]]
        many = np.flatnonzero(np.repeat(size > FEW, size))
        level = np.floor(np.log(n[many]) / -np.log(threshold)).astype(np.int64)
        order = np.lexsort((level, group[many]))
        many, level = many[order], level[order]
        edge = np.flatnonzero((np.diff(group[many]) != 0) | (np.diff(level) != 0)) + 1
        for part in np.split(many, edge) if len(many) else ():
            rights.append(np.full(len(part), part[_hub(f1[part], f2[part])]))
            lefts.append(part)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        keep = (node[left] != node[right]) & _alike(n, pos, f1, f2, left, right, threshold)
        a, b = node[left[keep]], node[right[keep]]
        none = np.zeros(len(a), np.int64)
        yield _rows(np.concatenate((np.minimum(a, b), node[many])), np.concatenate((np.maximum(a, b), token[many])), np.concatenate((np.full(len(a), -1, np.int32), n[many])), np.concatenate((none.astype(np.int32), pos[many])), np.concatenate((none, f1[many])), np.concatenate((none, f2[many])))

    return lambda batches: _grouped(batches, step)


def _rows(a, b, *more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, *more)], names=["a", "b", "n", "pos", "f1", "f2"][: 2 + len(more)])


def _apart(threshold: float) -> Callable:
    """Pairs that meet at a shingle, are alike and have different roots."""

    def step(token, node, n, pos, f1, f2, root):
        for lo, size in zip(*_starts(token), strict=True):
            rows = lo + np.argsort(n[lo : lo + size], kind="stable")
            if (root[rows] == root[rows[0]]).all():
                continue
            k = n[rows]
            end = np.searchsorted(k, k / threshold + 1e-9, "right")
            for i in range(size - 1):
                other = rows[i + 1 : end[i]]
                other = other[root[other] != root[rows[i]]]
                if len(other):
                    other = other[_alike(n, pos, f1, f2, np.full(len(other), rows[i]), other, threshold)]
                    a, b = node[rows[i]], node[other]
                    yield _rows(np.minimum(a, b), np.maximum(a, b))

    return lambda batches: _grouped(batches, step)


def near_copy_links(texts: DataFrame, sets: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, known: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between nodes of sets that join all that are similar enough; known: links that hold anyhow."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in binary_column(batch, "text"):
                found = shingles(x or b"", shingle)
                yield pa.RecordBatch.from_arrays([_signed([node_of(found)]), pa.array([found.tobytes()], pa.binary())], names=["node", "found"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(binary_column(batch, "x"), binary_column(batch, "y"), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("row")).select("node", F.col("row.id").alias("id"), F.col("row.uid").alias("uid"))

    def linked(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        rows = one.join(nodes, "node", "left_semi").select("id", "uid").distinct()
        found = materialize(texts.join(rows, texts["id"].eqNullSafe(rows["id"]) & (texts["uid"] == rows["uid"]), "left_semi").mapInArrow(whole, "node long, found binary").dropDuplicates(["node"]), "copies-sets")
        x, y = (found.select(F.col("node").alias(a), F.col("found").alias(b)) for a, b in (("u", "x"), ("v", "y")))
        return materialize(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(similar, "u long, v long"), "copies-links")

    rows = sets.groupBy("node").agg(*(F.first(x).alias(x) for x in ("n", "f1", "f2", "prefix"))).select(F.posexplode("prefix").alias("pos", "token"), "node", "n", "f1", "f2").select("token", "node", "n", "pos", "f1", "f2")
    met = materialize(rows.repartition("token").sortWithinPartitions("token").mapInArrow(_meet(threshold), "a long, b long, n int, pos int, f1 long, f2 long"), "copies-met")
    del rows
    tidy(texts.sparkSession)
    pairs = materialize(met.where("n < 0").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "copies-pairs")
    links = linked(pairs)
    if known is not None:
        links = links.unionByName(known)
    many = met.where("n >= 0").select(F.col("b").alias("token"), F.col("a").alias("node"), "n", "pos", "f1", "f2")
    if many.isEmpty():
        return links
    labelled = many.join(connected(links, "copies-first"), "node", "left").select("token", "node", "n", "pos", "f1", "f2", F.coalesce("root", "node").alias("root"))
    rest = labelled.repartition("token").sortWithinPartitions("token").mapInArrow(_apart(threshold), "a long, b long")
    rest = materialize(rest.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti"), "copies-rest")
    return links if rest.isEmpty() else links.unionByName(linked(rest))


def near_copy_components(docs: DataFrame, groups: DataFrame | None = None, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """id, uid (a hash of the text) and root (the group's least node) for every row of docs (doc_id, text).

    groups: (id, uid, root) of groups that are joined as well, say those of the fingerprints.
    """
    texts = keyed(docs)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, first, halves = [], [], [], []
            for x in binary_column(batch, "text"):
                found = shingles(x or b"", shingle)
                node.append(node_of(found))
                n.append(len(found))
                halves.append(sketch(found))
                first.append(prefix(found, common.value, threshold).view(np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            f1, f2 = (pa.array([x[i] for x in halves], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(node), pa.array(n, pa.int32()), lists, f1, f2], names=["id", "uid", "node", "n", "prefix", "f1", "f2"])

    sets = materialize(texts.mapInArrow(run, "id long, uid long, node long, n int, prefix array<long>, f1 long, f2 long"), "copies-prefix")
    known = None
    if groups is not None:
        a, b = sets.select("id", "uid", "node").distinct(), groups.select(F.col("id").alias("i"), F.col("uid").alias("u"), "root").distinct()
        both = materialize(a.join(b, a["id"].eqNullSafe(b["i"]) & (a["uid"] == b["u"])).select("node", "root").distinct(), "copies-known")
        known = both.join(both.groupBy("root").agg(F.min("node").alias("v")), "root").where("node != v").select(F.col("node").alias("u"), "v").distinct()
    roots = connected(near_copy_links(texts, sets, shingle, threshold, known), "copies-all")
    return sets.select("id", "uid", "node").join(roots, "node", "left").select("id", "uid", F.coalesce("root", "node").alias("root"))
