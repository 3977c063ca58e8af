"""Language identification that knows words first and falls back to shorter and shorter character n-grams.

A known word adds the logarithm of its frequency in each language. A word that is not known is looked up by its character
n-grams, with marks for its two ends: the longest order of which at least one n-gram is known gives the mean logarithm of the
known ones. A word of which nothing is known adds nothing.

The model is fitted on about ``per_language`` labelled documents of each language (all, if there are fewer), drawn by a hash of
``doc_id``, and keeps the ``words`` most frequent words and the ``grams`` most frequent n-grams of each order. So its size
depends on these parameters and the number of languages, not on the corpus, and it is sent to every task.

Results in odd cases: null text and text without a letter give ``und`` with score 0; documents without a language teach nothing;
without any labelled document every prediction is ``und``; a text of which nothing is known gets the language with most
documents; ties go to the language with more documents, then to the smaller name; rows that repeat are predicted each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Longest character n-gram, the ends of a word included.
ORDER = 5
#: Characters of a text whose words are counted at once.
PART = 1 << 20
_SMOOTH = 0.5


def words_of(text: str) -> Counter:
    """Lower-case runs of letters and how often they occur."""
    import regex

    letters = regex.compile(r"\p{L}+")
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(letters.findall(text[at:end].lower()))
        at = end
    return found


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Log frequencies by language. ``known[0]`` has the words, ``known[k]`` the n-grams of k characters: row in ``scores``."""

    languages: list[str]
    prior: np.ndarray
    known: list[dict[str, int]]
    scores: np.ndarray
    memory: dict[str, int] = field(default_factory=dict)
    extra: list[np.ndarray] = field(default_factory=list)

    def row(self, word: str) -> np.ndarray:
        """What an unknown word adds."""
        for order in range(min(ORDER, len(word) + 2), 0, -1):
            rows = [r for g in grams_of(word, order) if (r := self.known[order].get(g)) is not None]
            if rows:
                return self.scores[rows].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text) if text else None
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        known, total = self.known[0], self.prior.copy()
        rows, weights, others = [], [], []
        for w, n in counts.items():
            r = known.get(w)
            if r is None:
                others.append((w, n))
            else:
                rows.append(r)
                weights.append(n)
        if rows:
            total += np.asarray(weights, np.float64) @ self.scores[rows]
        for w, n in others:
            k = self.memory.get(w)
            if k is None:
                if len(self.memory) > 100_000:  # what is remembered of unknown words stays bounded
                    self.memory.clear()
                    self.extra.clear()
                k = self.memory[w] = len(self.extra)
                self.extra.append(self.row(w))
            total += n * self.extra[k]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}, "extra": []}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: the fifth of all whose crc32 of the number as text is divisible by 5.

    A document without a number is kept for testing too, so nothing is learnt from it.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(labelled: DataFrame, per_language: int = 4000, words: int = 40_000, grams: int = 20_000) -> Model:
    """A model from ``labelled(doc_id, text, lang)``."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = sorted(((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[1], x[0]))  # one row per language
    languages = [x for x, _ in sizes]
    number = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], np.zeros(0), [{} for _ in range(ORDER + 1)], np.zeros((0, 0), np.float32))
    share = F.element_at(F.create_map(*[F.lit(y) for x, n in sizes for y in (x, min(1.0, per_language / n))]), F.col("lang"))
    drawn = labelled.where(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") < share * F.lit(float(1 << 32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                found.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            for lang, c in found.items():
                yield pa.record_batch([pa.array(list(c)), pa.array([lang] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["gram", "lang", "n"])

    seen = drawn.select("text", "lang").mapInArrow(count, "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).persist()
    marked = F.concat(F.lit("^"), "gram", F.lit("$"))
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.length("marked") - F.col("k") + 1), lambda i: F.substring("marked", i, F.col("k"))))
    orders = seen.select(marked.alias("marked"), "lang", "n", F.explode(F.array(*[F.lit(k) for k in range(1, ORDER + 1)])).alias("k")).where(F.length("marked") >= F.col("k"))
    table = seen.select(F.lit(0).alias("k"), "gram", "lang", "n").unionByName(orders.select("k", parts.alias("gram"), "lang", "n"))
    table = table.groupBy("k", "gram", "lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("total"), "gram"))
    top = table.groupBy("k", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).withColumn("rank", rank)
    top = top.where(F.col("rank") <= F.when(F.col("k") == 0, words).otherwise(grams)).select("k", "gram", "by", "rank").orderBy("k", "rank").toArrow()
    seen.unpersist()
    known: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    counts = np.zeros((len(top), len(languages)))
    ks = top["k"].to_numpy()
    for row, (k, gram, by) in enumerate(zip(ks.tolist(), top["gram"].to_pylist(), top["by"].to_pylist(), strict=True)):
        known[k][gram] = row
        for x in by:
            counts[row, number[x["lang"]]] += x["n"]
    scores = np.zeros_like(counts)
    for k in range(ORDER + 1):
        own = counts[ks == k]
        scores[ks == k] = np.log((own + _SMOOTH) / (own.sum(axis=0) + _SMOOTH * max(1, len(own))))
    scores -= scores.mean(axis=1, keepdims=True)  # what all languages share decides nothing
    total = sum(n for _, n in sizes)
    return Model(languages, np.log(np.array([n / total for _, n in sizes])), known, scores.astype(np.float32))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            found = [model.predict(x.as_py()) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, **parameters: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs(doc_id, text, lang)``; held-out documents teach nothing."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **parameters)
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with all their columns; ``lang`` is the predicted language, or as given if no document teaches any."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **parameters)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            if model.languages:
                found = [model.predict(x.as_py())[0] for x in b.column(at)]
                b = b.set_column(lang, b.schema.field(lang), pa.array(found, b.schema.field(lang).type))
                yield b.filter(pa.array([x != UNKNOWN for x in found], pa.bool_()))
            else:
                yield b.filter(pa.array([bool(words_of(x.as_py() or "")) for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
