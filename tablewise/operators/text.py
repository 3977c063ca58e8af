"""Text measures, word-list sentiment and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as fixed
from tablewise.operators.measures import col
from tablewise.operators.profile import text_shape


def words(c: Column) -> Column:
    """Whitespace-separated lower-case words; an empty text has none."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def word_facts(column: str) -> Column:
    """``n``, ``unlike`` and ``hits`` (``pos``, ``neg``): how many words a text has, how many unlike ones, and how many of the two lists; the words are made once, by a lambda over one column."""
    listed = fixed.POSITIVE_WORDS + fixed.NEGATIVE_WORDS
    among = lambda w, some: F.filter(w, lambda t: t.isin(some))
    hits = lambda w: F.transform(F.array(among(w, listed)), lambda h: F.struct(F.size(among(h, fixed.POSITIVE_WORDS)).alias("pos"), F.size(among(h, fixed.NEGATIVE_WORDS)).alias("neg")))[0]
    return F.transform(F.array(words(F.coalesce(col(column), F.lit("")))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("unlike"), hits(w).alias("hits")))[0]


def with_facts(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` with the facts of a column's words, and the name that they have."""
    name = f"_{column}_words"
    return df.withColumn(name, word_facts(column)), name


def text_measures(df: DataFrame, column: str, facts: str | None = None) -> DataFrame:
    """Ten measures of a text column; ``facts`` is the column with those of its words, if there is one."""
    if facts is None:
        df, made = with_facts(df, column)
        return text_measures(df, column, made).drop(made)
    x = F.coalesce(col(column), F.lit(""))
    chars = F.length(x)
    n = col(facts)["n"]
    safe = F.greatest(chars, F.lit(1))
    return df.withColumns({
        f"{column}_char_count": chars,
        f"{column}_word_count": n.cast("int"),
        f"{column}_avg_word_length": chars / F.greatest(n, F.lit(1)),
        f"{column}_sentence_count": F.regexp_count(x, F.lit(r"[.!?]+")),
        f"{column}_uppercase_ratio": F.regexp_count(x, F.lit("[A-Z]")) / safe,
        f"{column}_digit_ratio": F.regexp_count(x, F.lit("[0-9]")) / safe,
        f"{column}_special_char_count": F.regexp_count(x, F.lit(r"[^a-zA-Z0-9\s]")),
        f"{column}_exclamation_count": F.regexp_count(x, F.lit("!")),
        f"{column}_question_count": F.regexp_count(x, F.lit(r"\?")),
        f"{column}_unique_word_ratio": col(facts)["unlike"] / F.greatest(n, F.lit(1)),
    })


def sentiment(df: DataFrame, column: str, facts: str | None = None) -> DataFrame:
    """Share of positive and negative words and their difference; ``facts`` as in ``text_measures``."""
    if facts is None:
        df, made = with_facts(df, column)
        return sentiment(df, column, made).drop(made)
    total = F.greatest(col(facts)["n"], F.lit(1))
    pos, neg = col(facts)["hits"]["pos"], col(facts)["hits"]["neg"]
    return df.withColumns({
        f"{column}_positive_ratio": pos / total, f"{column}_negative_ratio": neg / total, f"{column}_sentiment_score": (pos - neg) / total})


def grams(column: str, stop_words: Sequence[str] | None = None, pairs: bool = True) -> Column:
    """The words of a text without stop words, and its pairs of neighbouring words, as one array."""
    stop = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")
    cleaned = F.regexp_replace(F.lower(F.coalesce(col(column), F.lit(""))), r"[^a-zA-Z\s]", " ")
    w = F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(stop))
    if not pairs:
        return w
    # a lambda over one column: the words are made once
    both = F.transform(F.array(w), lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))
    return both[0]


#: Words whose counts a task makes at once.
WORDS_AT_ONCE = 4_000_000


LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def letter_words(column: pa.Array) -> pa.Array:
    """The runs of ASCII letters of each text, as lists; null has none."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = LETTERS[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]  # words end with their text
    opens[edges], closes[edges[edges > 0] - 1] = inside[edges], inside[edges[edges > 0] - 1]
    starts = np.flatnonzero(opens)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(closes) + 1 - starts)]).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, offsets)), values)


def coded(words: pa.Array, stop: Sequence[str] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Unlike words, and of every word that counts (two letters or more, no stop word) its number among these and its text."""
    found = words.flatten().dictionary_encode()
    names, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
    counts = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, pa.array(list(stop), names.type)))).to_numpy(zero_copy_only=False)
    keep = counts[code] if len(code) else np.zeros(0, bool)
    return names, code[keep], row[keep]


def tallied(words: pa.Array, pairs: bool = True, stop: Sequence[str] = ()) -> pa.RecordBatch:
    """(term, df, cf) of some texts, each a list of its words: numbers stand for words, a pair is a number of two."""
    names, code, row = coded(words, stop)
    names, n, v = names.cast(pa.string()), max(1, len(words)), max(1, len(names))

    def tally(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, times = np.unique(term * n + row, return_counts=True)
        term = cell // n
        first = np.flatnonzero(np.diff(term, prepend=-1))
        return term[first], np.diff(first, append=len(cell)), np.add.reduceat(times, first) if len(first) else times

    term, df, cf = tally(code, row)
    text = names.take(pa.array(term))
    if pairs:
        at = np.flatnonzero(row[1:] == row[:-1])
        both, more, often = tally(code[at] * v + code[at + 1], row[at])
        text = pa.concat_arrays([text, pc.binary_join_element_wise(names.take(pa.array(both // v)), names.take(pa.array(both % v)), " ")])
        df, cf = np.concatenate([df, more]), np.concatenate([cf, often])
    return pa.record_batch([text, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"])


def term_counts(df: DataFrame, key: str, column: str, stop_words: Sequence[str] | None = None, pairs: bool = True) -> DataFrame:
    """(term, df, cf): in how many texts a term is, and how often in all.

    A task counts the terms of its texts before the shuffle and passes on one row per term, not one per text and
    term. Rows that share a key are one text: these alone are counted by key and term first.
    """
    data = df.select(col(key).alias("key"), col(column).alias("text"))
    again = data.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("other"))
    some = not again.isEmpty()
    same = F.col("key").eqNullSafe(F.col("other"))
    single = data.join(again, same, "left_anti") if some else data

    stop = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")

    def count(batches):
        for b in batches:
            w = letter_words(b.column(0))
            ends = np.cumsum(w.value_lengths().to_numpy())
            cuts = [0, *np.flatnonzero(np.diff(ends // WORDS_AT_ONCE)) + 1, len(w)] if len(w) else []
            for lo, hi in zip(cuts, cuts[1:]):
                yield tallied(w.slice(lo, hi - lo), pairs, stop)

    found = single.select(F.lower("text")).mapInArrow(count, "term string, df long, cf long")
    if some:
        shared = data.join(again, same, "left_semi").select("key", F.explode(grams("text", stop_words, pairs)).alias("term"))
        found = found.union(shared.groupBy("key", "term").agg(F.count("*").alias("cf")).select("term", F.lit(1).cast("long"), "cf"))
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(counts: DataFrame, n_texts: int, size: int = 50, min_df: int = 2, max_df: float = 0.95) -> dict[str, float]:
    """The ``size`` most frequent terms, sorted, with their smooth idf."""
    best = (
        counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_texts))
        .orderBy(F.desc("cf"), "term").limit(size)
        .select("term", (F.log((1.0 + n_texts) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    )
    return {r["term"]: r["idf"] for r in sorted(best.collect())}  # at most ``size``


def weighted_terms(df: DataFrame, key: str, column: str, vocab: dict[str, float], stop_words: Sequence[str] | None = None, pairs: bool = True) -> DataFrame:
    """(key, term, w): tf times idf of the vocabulary's terms in each text; a task counts them in its rows, others never leave it."""
    stop = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")
    terms = list(vocab)

    def known(batches):
        for b in batches:
            names, code, row = coded(letter_words(b.column(1)), stop)
            v = max(1, len(names))
            number = {x: i for i, x in enumerate(names.to_pylist())}
            at = np.flatnonzero(row[1:] == row[:-1]) if pairs else np.zeros(0, np.int64)
            both = code[at] * v + code[at + 1]
            for term in terms:
                parts = [number.get(x) for x in term.split(" ")]
                if None in parts or len(parts) > 1 + pairs:
                    continue
                rows = row[code == parts[0]] if len(parts) == 1 else row[at[both == parts[0] * v + parts[1]]]
                held, tf = np.unique(rows, return_counts=True)
                if len(held):
                    yield pa.record_batch([b.column(0).take(pa.array(held)), pa.array([term] * len(held)), pa.array(tf, pa.int64())], ["key", "term", "n"])

    data = df.select(col(key).alias("key"), F.lower(col(column)))
    shape = T.StructType([data.schema[0], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    found = data.mapInArrow(known, shape).groupBy("key", "term").agg(F.sum("n").alias("tf"))
    numbers = df.sparkSession.createDataFrame(list(vocab.items()), "term string, idf double")
    return found.join(numbers, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf(df: DataFrame, key: str, column: str, size: int = 50, stop_words: Sequence[str] | None = None) -> DataFrame:
    """(key, term, weight): TF-IDF of the vocabulary terms, L2-normalised per text."""
    return tfidf_of(df, key, column, vocabulary(term_counts(df, key, column, stop_words), df.count(), size), stop_words)


def tfidf_of(df: DataFrame, key: str, column: str, vocab: dict[str, float], stop_words: Sequence[str] | None = None) -> DataFrame:
    raw = weighted_terms(df, key, column, vocab, stop_words)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return raw.select("key", "term", (F.col("w") / norm).alias("weight"))


def text_features(df: DataFrame, key: str, columns: Sequence[str] | None = None, size: int = 10, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Replace natural-text columns by their measures, sentiment and TF-IDF columns."""
    if columns is None:
        columns = [r["column"] for r in text_shape(df).collect() if r["is_text"]]
    out = df
    for c in columns:
        vocab = vocabulary(term_counts(df, key, c, stop_words), df.count(), size)
        weights, names = tfidf_of(df, key, c, vocab, stop_words), list(vocab)  # each of these terms is in two texts at least
        wide = weights.groupBy("key").pivot("term", names).agg(F.first("weight"))
        wide = wide.select(F.col("key").alias(key), *[F.col(f"`{t}`").alias(f"{c}_tfidf_{t.replace(' ', '_')}") for t in names])
        out, facts = with_facts(out, c)
        out = sentiment(text_measures(out, c, facts), c, facts).drop(c, facts).join(wide, key, "left").fillna(0.0, wide.columns[1:])
    return out
