"""Quality of documents: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of every whole text are taken once and written. Labelled documents are standardised and mapped to ``width`` random
Fourier features, whose inner products approximate a Gaussian kernel. Every task sums the normal equations of its rows and
passes on one matrix row after the other; the sums are solved in the driver, whose share depends on ``width`` alone.
Raw scores of the labelled documents, counted in ``BINS`` bins, are made monotone by pooling adjacent violators.

Results in odd cases: null counts as empty text, whose statistics are 0 and which is scored like any other; documents without a
label teach nothing; a document with several labels teaches their mean; without labels every score is 0.5; rows that
repeat are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.arrays import Texts, texts, word_hashes
from tablewise.llm.languages import held_out
from tablewise.llm.shared import written

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "shout": b"!?",
    "bar": b"|",
    "quote": b"\"'()-:;",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "beyond": range(0x80, 0xC0),  # one per character outside ASCII or more
    "control": [*range(0x09), *range(0x0E, 0x20), 0x7F],
}
WORD_STATISTICS = ("mean_word", "short_words", "long_words", "same_as_last", "same_as_last_but_one", "distinct_words", "word_mass", "odd_ends", "capitals")
NAMES = ("log_bytes", "log_words", *KINDS, *WORD_STATISTICS)
BINS = 2000
#: Raw scores are counted between these.
LOW, HIGH = -0.5, 1.5


def _per_text(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(counted, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(t: Texts) -> np.ndarray:
    """A row of NAMES for each text."""
    size, count = np.diff(t.offsets), np.diff(t.words)
    some = np.maximum(size, 1)
    out = [np.log1p(size), np.log1p(count)]
    for kind in KINDS.values():
        member = np.zeros(256, np.uint8)
        member[list(kind)] = 1
        out.append(_per_text(member[t.data], t.offsets) / some)
    words = np.maximum(count, 1)
    length = t.ends - t.starts
    hashes = word_hashes(t, lower=True)
    doc = np.repeat(np.arange(len(t)), count)
    same = [np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)]
    for back in (1, 2):
        same[back - 1][back:] = (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
    ordered = hashes.copy()
    for lo, hi in zip(t.words[:-1].tolist(), t.words[1:].tolist(), strict=True):
        if hi - lo > 1:
            ordered[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(hashes)))
    mass = np.bincount(doc[begin], runs.astype(np.float64) ** 2, len(t)) if len(begin) else np.zeros(len(t))
    last, first = t.data[t.ends - 1] if len(hashes) else t.data[:0], t.data[t.starts] if len(hashes) else t.data[:0]
    plain = ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A) | (last >= 0x80) | np.isin(last, np.frombuffer(b".,", np.uint8))
    capital = (first >= 0x41) & (first <= 0x5A)
    for counted in (length, length <= 3, length >= 14, same[0], same[1], new):
        out.append(_per_text(counted, t.words) / words)
    out.append(mass / words**2)
    out += [_per_text(x, t.words) / words for x in (~plain, capital)]
    return np.stack(out, axis=1).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row of ``docs(doc_id, text)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                found = statistics(t)
                yield pa.record_batch([b.column(0).slice(t.first, len(t)), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(NAMES)))], ["doc_id", *NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, " + ", ".join(f"{n} float" for n in NAMES))


class Scorer:
    """Raw scores of statistics, and their calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.waves = rng.normal(size=(len(mean), width)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, width)
        self.weights = np.zeros(width + 1)
        self.raw, self.shown = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -5, 5)
        waves = np.cos(x @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1).astype(np.float64) if len(b) else np.zeros((0, len(NAMES)))


def normal_equations(rows: DataFrame, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over ``rows(label, statistics)``: summed per task, then per row of the matrix."""
    sent = rows.sparkSession.sparkContext.broadcast(scorer)
    size = len(scorer.weights)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                z = sent.value.features(_matrix(part))
                total += z.T @ np.hstack([z, part.column("label").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.record_batch([pa.array(np.arange(size)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(sums)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "sums"])

    kind = "i long, sums binary"
    found = rows.mapInArrow(own, kind).repartition("i").mapInArrow(add, kind).orderBy("i").collect()  # one row per feature
    both = np.stack([np.frombuffer(r["sums"]) for r in found]) if found else np.zeros((size, size + 1))
    return both[:, :-1], both[:, -1]


def pooled(count: np.ndarray, positive: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the isotonic fit to bins with ``count`` rows and ``positive`` labels: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for n, s, x in zip(count.tolist(), positive.tolist(), at.tolist(), strict=True):
        blocks.append([n, s, n * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(labelled: DataFrame, width: int = 300, penalty: float = 0.1, seed: int = 11) -> Scorer:
    """A scorer from ``labelled(label, statistics)``, from all its rows."""
    moments = labelled.agg(*[f(n).alias(f"{n}_{k}") for n in NAMES for k, f in (("mean", F.avg), ("spread", F.stddev_pop))]).first()
    of = lambda k, other: np.array([other if moments[f"{n}_{k}"] is None else moments[f"{n}_{k}"] for n in NAMES], float)
    scorer = Scorer(of("mean", 0.0), np.maximum(of("spread", 1.0), 1e-4), width, seed)
    left, right = normal_equations(labelled, scorer)
    if not left[-1, -1]:
        return scorer
    scorer.weights = np.linalg.solve(left + penalty * np.eye(len(left)), right)
    sent = labelled.sparkSession.sparkContext.broadcast(scorer)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, positive = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            at = np.clip((sent.value.score(_matrix(b)) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            count += np.bincount(at, minlength=BINS)
            positive += np.bincount(at, b.column("label").to_numpy(zero_copy_only=False), BINS)
        on = np.flatnonzero(count)
        yield pa.record_batch([pa.array(on), pa.array(count[on]), pa.array(positive[on])], ["bin", "n", "positive"])

    bins = labelled.mapInArrow(binned, "bin long, n double, positive double").groupBy("bin").agg(F.sum("n"), F.sum("positive")).orderBy("bin").collect()  # at most BINS rows
    bin_, n, positive = (np.array(x, float) for x in zip(*bins, strict=True))
    scorer.raw, scorer.shown = pooled(n, positive, LOW + (bin_ + 0.5) * (HIGH - LOW) / BINS)
    return scorer


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters: float) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` has 1 for good and 0 for bad documents; those of held-out documents are not learnt from.
    """
    found = written(measured(docs), "statistics")
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    train = written(found.join(known, "doc_id"), "labelled")
    sent = docs.sparkSession.sparkContext.broadcast(fit(train, **parameters))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for b in batches:
            score = np.concatenate([np.interp(scorer.score(_matrix(b.slice(lo, 4096))), scorer.raw, scorer.shown) for lo in range(0, max(len(b), 1), 4096)])
            yield pa.record_batch([b.column("doc_id"), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    return found.mapInArrow(of, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
