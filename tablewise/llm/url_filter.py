"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The classifier learns from a small labelled table of URLs of at most ``most`` rows (those with the smallest hashes, if there are more);
so the fit, done in the driver, does not grow with the table that is judged. Judging is one pass over the rows.

Results in odd cases: a null URL or one without ``://`` has an empty host and path, no rule fits it and the classifier decides by what
it knows of empty parts; rules of equal length are taken in the order given; rows that repeat are judged each; without labelled URLs
of both kinds everything is allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.arrays import flat, window_hashes

ALLOW, BLOCK = "allow", "block"
#: A verdict, a host (with all its subdomains), and how the path must start.
Rule = tuple[str, str, str]
SIZES = (3, 4, 5)
#: Number of weights; n-grams of the path have the upper half.
WIDTH = 1 << 18


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return blank(F.translate(host, string.ascii_uppercase, string.ascii_lowercase)), blank(path)


def fitting(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``, else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the longest ends up outermost
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of the n-grams of each row, and where each row's begin; ends are marked."""
    found, owner = [], []
    for half, column in enumerate((hosts, paths)):
        data, offsets = flat(column)
        n = len(offsets) - 1
        marked = np.full(len(data) + 2 * n, ord("\n"), np.uint64)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        marked[np.arange(len(data)) + 2 * doc + 1] = data
        begin = offsets + 2 * np.arange(n + 1)
        for size in SIZES:
            count = np.maximum(np.diff(begin) - size + 1, 0)
            row = np.repeat(np.arange(n), count)
            start = begin[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
            hashes = window_hashes(marked, size)[start]
            found.append((hashes % np.uint64(WIDTH // 2)).astype(np.int64) + half * (WIDTH // 2))
            owner.append(row)
    number, row = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(row, kind="stable")
    return number[order], np.searchsorted(row[order], np.arange(len(hosts) + 1))


def margins(number: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each row's n-grams, scaled by the root of their number, and the constant."""
    sums = np.concatenate([[0], np.cumsum(weights[:-1][number])])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(np.diff(offsets), 1)) + weights[-1]


def fit(labelled: DataFrame, most: int = 20_000, steps: int = 200, penalty: float = 1e-3) -> np.ndarray:
    """Weights from ``labelled(host, path, blocked)``; kinds count alike however many rows each has."""
    rows = labelled.select("host", "path", "blocked").distinct().orderBy(F.md5(F.concat("host", F.lit("\n"), "path")), "host", "path", "blocked").limit(most).toArrow()
    y = rows["blocked"].to_numpy().astype(np.float64)
    weights = np.zeros(WIDTH + 1)
    if not 0 < y.sum() < len(y):
        weights[-1] = -1.0
        return weights
    number, offsets = features(rows["host"].combine_chunks(), rows["path"].combine_chunks())
    scale = 1 / np.sqrt(np.maximum(np.diff(offsets), 1))
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    speed = np.zeros(WIDTH + 1)
    for _ in range(steps):  # accelerated gradient descent; the features of a row have length 1 or so, the constant 1
        ahead = weights + 0.9 * speed
        wrong = share * (1 / (1 + np.exp(-np.clip(margins(number, offsets, ahead), -30, 30))) - y)
        slope = np.append(np.bincount(number, (wrong * scale)[row], WIDTH), wrong.sum()) + penalty * ahead
        speed = 0.9 * speed - 1.0 * slope
        weights = weights + speed
    return weights


def judged(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, most: int = 20_000) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``blocked_score`` of every row of ``pages(page_id, url)``.

    ``labelled(url, blocked)`` has the URLs to learn from; without it they are the pages that rules decide.
    """
    host, path = parts(F.col("url"))
    name, kind = fitting(rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "kind": kind})
    if labelled is None:
        known = split.where(F.col("kind").isNotNull()).select("host", "path", (F.col("kind") == BLOCK).cast("int").alias("blocked"))
    else:
        known = labelled.select(*[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"), strict=True)], F.col("blocked").cast("int").alias("blocked")).where(F.col("blocked").isNotNull())
    sent = pages.sparkSession.sparkContext.broadcast(fit(known, most).astype(np.float32))  # WIDTH + 1 weights

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.astype(np.float64)
        for b in batches:
            score = 1 / (1 + np.exp(-np.clip(margins(*features(b.column(1), b.column(2)), weights), -30, 30)))
            yield pa.record_batch([*b.columns, pa.array(score)], [*b.schema.names, "blocked_score"])

    found = split.mapInArrow(of, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, kind string, blocked_score double")
    verdict = F.coalesce("kind", F.when(F.col("blocked_score") >= 0.5, BLOCK).otherwise(ALLOW))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "blocked_score")
