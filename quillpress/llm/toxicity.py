"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with marks for its ends) and of itself, each
hashed to a row of an embedding table; a misspelt word shares most of its n-grams with the word
it stands for, so it need not have been seen.  A window of words is the average of its distinct
words' bags, and a linear softmax over that average gives its two class probabilities.  Embeddings and
softmax are trained together by mini-batch gradient descent with AdaGrad steps.

Labels are of documents, and a long document may be toxic in one sentence only.  So windows are
scored, and a document is as toxic as its worst window: after a first pass over all windows of
the sample, only the worst windows of a toxic document keep its label (multiple-instance
learning).  Logistic calibration on the same sample turns the worst window's logit to a
probability.

Only the fit uses a sample: at most `max_docs` labelled rows of each class, those with the least
hash of the id, as far as their words make `max_bytes` bytes (a row that does not fit in what is
left of them is passed over); of a row that is taken every window is read.  Scores use every word
of every text.  Averaging is linear, so for scoring a word is one number, looked up or computed
once in a task, and a document costs a running sum over its words, from which a word's later
places are taken off in the windows that hold an earlier one.

A word over 40 bytes (a clause of a script without spaces, or a run of letters) is cut into
overlapping pieces that each count as a word, so all of it is read.

Defined results: a null text counts as empty, and an empty text has the score of a window
without words; a label that is null takes no part in the fit, and if an id has several labels
the highest counts; without any label of one of the classes every score is the share of toxic
labels (0 without labels); repeated rows give a row each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_scan import words_of
from .shared import binary_column, materialize, ship


@dataclass(frozen=True)
class Settings:
    window: int = 16
    buckets: int = 1 << 17
    dims: int = 4
    shortest: int = 3
    longest: int = 6
    max_docs: int = 2500
    max_bytes: int = 1 << 23
    epochs: int = 6
    steps: int = 500
    rate: float = 0.2
    batch: int = 256
    seed: int = 7
    threshold: float = 0.7


#: A longer word is read as pieces of PIECE bytes, each STEP bytes after the one before, the last one at its end.
LONG, PIECE, STEP = 40, 20, 10


def pieces_of(data: bytes) -> list[bytes]:
    """The words of a text, long ones in pieces."""
    words = words_of(data)
    if not words or max(map(len, words)) <= LONG:
        return words
    out = []
    for w in words:
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [w[a : a + PIECE] for a in range(0, len(w) - PIECE, STEP)]
            out.append(w[-PIECE:])
    return out


def subwords(word: bytes, s: Settings) -> list[int]:
    """Rows of the embedding table: the word's and its n-grams'."""
    marked = b"<" + word + b">"
    crc, mask = zlib.crc32, s.buckets - 1
    found = [crc(marked) & mask]
    for n in range(s.shortest, s.longest + 1):
        found += [crc(marked[i : i + n]) & mask for i in range(len(marked) - n + 1)]
    return found


def windows_of(words: list, s: Settings) -> list[list]:
    """Distinct words of half-overlapping windows that hold every word."""
    return [list(dict.fromkeys(words[a : a + s.window])) for a in range(0, max(1, len(words) - s.window // 2), s.window // 2)]


class Bag:
    """Documents as flat arrays: their words' numbers, each window's document and words, each distinct word's rows of the table."""

    def __init__(self, docs: Iterable[list[bytes]], s: Settings):
        index: dict[bytes, int] = {}
        text, text_first = array("i"), array("q", [0])
        words, first, doc, rows, row_first = array("i"), array("q", [0]), array("i"), array("i"), array("q", [0])
        self.docs = 0
        for given in docs:
            mine = []
            for w in given:
                at = index.setdefault(w, len(index))
                mine.append(at)
                if at == len(row_first) - 1:  # a new word
                    rows.extend(subwords(w, s))
                    row_first.append(len(rows))
            text.extend(mine)
            text_first.append(len(text))
            for window in windows_of(mine, s):
                words.extend(window)
                first.append(len(words))
                doc.append(self.docs)
            self.docs += 1
        of = lambda x, kind: np.frombuffer(x, kind)  # noqa: E731  the arrays' own memory
        self.words, self.first, self.doc = of(words, np.int32), of(first, np.int64), of(doc, np.int32)
        self.rows, self.row_first = of(rows, np.int32), of(row_first, np.int64)
        self.text, self.text_first = of(text, np.int32), of(text_first, np.int64)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


class Model:
    """Embedding table and softmax; a pad counts as a zero vector, so a window's average is over its full width."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s, self.rng, self.batch = s, rng, s.batch
        self.table = rng.uniform(-1, 1, (s.buckets, s.dims)).astype(np.float32) / s.dims
        self.out = np.zeros((s.dims, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.table_sums, self.out_sums, self.bias_sums = (np.zeros(x.shape, np.float32) for x in (self.table, self.out, self.bias))

    def epoch(self, bag: Bag, chosen: np.ndarray, label: np.ndarray, rate: float) -> None:
        """One pass over the chosen windows."""
        order = self.rng.permutation(len(chosen))
        for at in range(0, len(order), self.batch):
            mine = order[at : at + self.batch]
            _, used, to_row, to_out, to_bias = self.gradients(bag, chosen[mine], label[mine])
            for value, sums, where, grad in ((self.out, self.out_sums, slice(None), to_out), (self.bias, self.bias_sums, slice(None), to_bias), (self.table, self.table_sums, used, to_row)):
                sums[where] += grad**2  # AdaGrad: rows that many words share take shorter steps
                value[where] -= rate * grad / (np.sqrt(sums[where]) + 1e-6)

    def gradients(self, bag: Bag, mine: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Loss of windows, the table's rows that they use, and its gradient by these rows, the softmax and its bias: through the average to every n-gram."""
        owner, where = _ranges(bag.first[mine], bag.first[mine + 1])
        words, inverse = np.unique(bag.words[where], return_inverse=True)
        holder, rows = _ranges(bag.row_first[words], bag.row_first[words + 1])
        rows, share = bag.rows[rows], 1.0 / (bag.row_first[words + 1] - bag.row_first[words])
        vec = np.stack([np.bincount(holder, self.table[rows, d], len(words)) for d in range(self.s.dims)], 1) * share[:, None]
        mean = np.stack([np.bincount(owner, vec[inverse, d], len(mine)) for d in range(self.s.dims)], 1) / self.s.window
        logit = 8.0 * mean @ self.out + self.bias
        prob = np.exp(logit - logit.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        loss = -float(np.log(prob[np.arange(len(y)), y]).sum())
        error = prob - np.eye(2)[y]
        back = 8.0 * (error @ self.out.T) / self.s.window  # per window
        to_word = np.stack([np.bincount(inverse, back[owner, d], len(words)) for d in range(self.s.dims)], 1) * share[:, None]
        used, at_row = np.unique(rows, return_inverse=True)
        to_row = np.stack([np.bincount(at_row, to_word[holder, d], len(used)) for d in range(self.s.dims)], 1)
        return loss, used, to_row, 8.0 * mean.T @ error, error.sum(axis=0)

    def direction(self) -> tuple[np.ndarray, float]:
        """(weight of each row of the table in the logit of class 1, the bias)."""
        return 8.0 * self.table @ (self.out[:, 1] - self.out[:, 0]) / self.s.window, float(self.bias[1] - self.bias[0])

    def of_words(self, bag: Bag) -> np.ndarray:
        """What each distinct word adds to the logit of a window."""
        weight, _ = self.direction()
        of_word = np.empty(len(bag.row_first) - 1)
        for at in range(0, len(of_word), 1 << 16):
            edge = bag.row_first[at : at + (1 << 16) + 1]
            of_word[at : at + (1 << 16)] = np.add.reduceat(weight[bag.rows[edge[0] : edge[-1]]].astype(np.float64), edge[:-1] - edge[0]) / np.diff(edge)
        return of_word

    def logits(self, bag: Bag) -> np.ndarray:
        of_word, out = self.of_words(bag), np.empty(len(bag.doc))
        for at in range(0, len(out), 1 << 16):
            edge = bag.first[at : at + (1 << 16) + 1]
            owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            out[at : at + (1 << 16)] = np.bincount(owner, of_word[bag.words[edge[0] : edge[-1]]], len(edge) - 1)
        return out + self.direction()[1]


def train(texts: list[bytes], labels: list[int], s: Settings) -> Scorer:
    """Fit on labelled texts."""
    return train_words((pieces_of(x) for x in texts), labels, s)


def train_words(docs: Iterable[list[bytes]], labels: list[int], s: Settings) -> Scorer:
    """Fit on the words of labelled documents, which are read once."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Scorer(np.zeros(s.buckets, np.float32), 0.0, 0.0, float(np.clip(_logit(y.mean() if len(y) else 0.0), -9, 9)), s)
    model, bag = Model(s), Bag(docs, s)
    doc = bag.doc
    toxic = y[doc] == 1
    chosen = np.arange(len(doc))
    # a small sample gets smaller batches and more passes, so that it is learnt as well
    model.batch = int(np.clip(len(doc) // 64, 16, s.batch))
    passes = max(s.epochs, min(40, -(-s.steps * model.batch // len(doc))))
    for i in range(passes):
        model.epoch(bag, chosen, y[doc[chosen]], s.rate * (1 - i / (passes + 1)))
        logit = model.logits(bag)
        order = np.lexsort((-logit, doc))  # the worst windows of each document first
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        chosen = np.flatnonzero(~toxic | (rank < (3 if i + 1 < passes // 2 else 1)))
    weight, bias = model.direction()
    of_word = model.of_words(bag)
    worst = [worst_window(x, of_word[x], s.window) + bias for x in np.split(bag.text, bag.text_first[1:-1])]
    return Scorer(weight.astype(np.float32), bias, *_calibrate(np.array(worst), y), s)


def worst_window(at: np.ndarray, value: np.ndarray, w: int) -> float:
    """The largest sum of the values of w consecutive words (numbers `at`), each distinct word counted once; 0 without words."""
    n = len(at)
    if not n:
        return 0.0
    last = max(0, n - w)  # the last window's start
    run = np.concatenate(([0.0], np.cumsum(value)))
    total = run[min(w, n) :] - run[: last + 1]
    order = np.argsort(at, kind="stable")
    again = np.flatnonzero((at[order][1:] == at[order][:-1]) & (np.diff(order) < w))
    if len(again):  # a word's place and its next one: windows from `first` to `stop` hold both
        here, later = order[again], order[again + 1]
        first, stop = np.maximum(0, later - w + 1), np.minimum(here, last)
        take = np.bincount(first, value[here], last + 2) - np.bincount(stop + 1, value[here], last + 2)
        total = total - np.cumsum(take)[: last + 1]
    return float(total.max())


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, the slope kept positive; both classes weigh the same, whatever their counts."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    w, each = np.array([1.0, 0.0]), len(y) / 2 / np.bincount(y, minlength=2)[y]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (each * (p - y)) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    a = max(w[0], 1e-3) / spread
    return float(a), float(w[1] - a * mean)


class Scorer:
    """What scoring needs: a number for each row of the table, and the calibration."""

    def __init__(self, weight: np.ndarray, bias: float, a: float, b: float, s: Settings):
        self.weight, self.bias, self.a, self.b, self.s = weight, bias, a, b, s

    def start(self) -> Scorer:
        """Forget all words; their numbers and values are learnt again as they come."""
        self.known: dict[bytes, int] = {}
        self.value = np.empty(1 << 12)
        return self

    def _learn(self, words: set[bytes]) -> None:
        new = list(words)
        rows = [subwords(w, self.s) for w in new]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for x in rows for r in x), np.int64, int(size.sum()))
        at = len(self.known)
        while at + len(new) > len(self.value):
            self.value = np.concatenate((self.value, np.empty_like(self.value)))
        self.value[at : at + len(new)] = np.add.reduceat(self.weight[flat].astype(np.float64), np.cumsum(size) - size) / size
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def logit(self, words: list[bytes]) -> float:
        """Of the worst window of consecutive words, in which each distinct word counts once."""
        known = self.known
        try:
            at = np.array([known[x] for x in words], np.int64)
        except KeyError:
            if len(known) > 300_000:  # a cache only: what is dropped is computed again
                known.clear()
            self._learn(set(words).difference(known))
            at = np.array([known[x] for x in words], np.int64)
        return worst_window(at, self.value[at], self.s.window) + self.bias

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.logit(pieces_of(data)) + self.b, -30, 30))))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3


def sampled(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, s: Settings) -> DataFrame:
    """(id, label, words): the bounded sample of labelled rows, words joined by spaces."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(usable).groupBy("id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("id"), F.col("id"))
    pick = known.where("label = 1").orderBy(*order).limit(s.max_docs).unionByName(known.where("label = 0").orderBy(*order).limit(s.max_docs))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(binary_column(batch, "text")):
                words = b" ".join(pieces_of(x))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in (0, 1)), pa.array([len(words)], pa.int64()), pa.array([words], pa.binary())], names=["id", "label", "size", "words"])

    rows = text.join(F.broadcast(pick), "id").select("id", "label", "text").mapInArrow(cut, "id long, label int, size long, words binary")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("words", "size")).alias("x")).select("id", "label", "x.size", "x.words")  # a row for each id, however often it stands
    rows = materialize(rows, "toxicity-sample")
    room, taken = {0: s.max_bytes, 1: s.max_bytes}, []
    for r in rows.select("id", "label", "size", F.xxhash64("id").alias("order")).orderBy("order", "id").collect():  # 2 * max_docs rows
        if r["size"] <= room[r["label"]]:
            room[r["label"]] -= r["size"]
            taken.append(r["id"])
    return rows.where(F.col("id").isin(taken)).select("id", "label", "words")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings()) -> Scorer:
    """Fit on a bounded sample of the labelled rows where usable (over the column named id) holds, in one task that gets its 2 * max_bytes bytes."""
    found = sampled(docs, labels, usable, id_col, text_col, label_col, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).cast(schema) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.take(pc.sort_indices(table["id"]))
        made = train_words((x.as_py().split() for x in table["words"]), table["label"].to_pylist(), s)
        yield pa.RecordBatch.from_arrays([pa.array([made.weight.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (made.bias, made.a, made.b))], names=["weight", "bias", "a", "b"])

    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("words", pa.binary())])
    made = found.repartition(1).mapInArrow(run, "weight binary, bias double, a double, b double").first()
    return train_words([], [], s) if made is None else Scorer(np.frombuffer(bytes(made["weight"]), np.float32), made["bias"], made["a"], made["b"], s)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, score and predicted for every row; carry names columns to pass through unchanged."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((scorer.weight, scorer.bias, scorer.a, scorer.b, scorer.s))  # buckets x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*model.value).start()
        for batch in batches:
            found = np.array([own.score(x or b"") for x in binary_column(batch, name)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[own_text:], pa.array(found)], names=[*batch.schema.names[own_text:], "__score"])

    name, own_text = (text_col, 0) if text_col in carry else ("__text", 1)
    rows = docs.select(*([F.col(text_col).cast("string").alias(name)] if own_text else []), F.col(id_col).cast("long").alias("__id"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[own_text:])
    return rows.mapInArrow(run, f"{schema}, __score double").withColumn("__predicted", (F.col("__score") >= scorer.s.threshold).cast("int"))
