"""Word sequences that repeat, by prefix-partitioned suffix trees.

A suffix is what follows a word of a document, and only its first ``length`` words matter here. Suffixes are split by their prefix:
by the first word, and where too many share that, by the first two, four and so on words, until a group of prefixes fits the memory
of a task. A task builds the subtrees of its prefixes as sorted runs: suffixes in the order of the hashes of their
first ``length`` words, so that the suffixes below one deep node stand together. A node with two or more suffixes is a repeat;
all of them but the first in ``(doc_id, position)`` order are marked, and marked windows that touch or overlap are
the maximal repeated spans of a document.

Before suffixes are sent, those of one piece of the input that agree in all ``length`` words are reduced to the first; the others
are marked at once. So a passage that a third of all documents share is sent once per piece, and the longest prefix needs no
further split. What is sent are columns of numbers (differences of sorted hashes, document, position), not rows.

Hashes of 64 bits stand for words and windows; equal hashes are taken for equal words. Counts of prefixes are kept in ``BUCKETS``
buckets of each prefix length or more, in proportion to the tasks.

Results in odd cases: null and empty texts, and texts shorter than a window, have no repeats; a null ``doc_id`` counts as the smallest;
rows that repeat a ``doc_id`` and its text (both may be null) are one document and get the same result; unlike texts of one ``doc_id``, or
without one, are documents of their own, in the order of a hash of the text (``own``), which is only sent where a number has unlike texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.arrays import WHITE, Texts, texts, window_hashes, word_hashes
from tablewise.llm.shared import given, number, tasks, text_key, written

#: Text whose suffixes are reduced together.
PIECE_BYTES = 4 << 20
#: Suffixes that a task holds.
GROUP = 1_000_000
BUCKETS = 4096


def levels(length: int) -> list[int]:
    """Lengths of prefixes: 1, 2, 4 and so on, and the whole window."""
    return [1 << k for k in range(length.bit_length()) if 1 << k < length] + [length]


def _suffixes(t: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of each window its first word and its text."""
    hashes = word_hashes(t)
    own = np.maximum(np.diff(t.words) - length + 1, 0)
    doc = np.repeat(np.arange(len(t)), own)
    return hashes, np.arange(len(doc)) - (np.cumsum(own) - own)[doc] + t.words[:-1][doc], doc


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def prefix_counts(docs: DataFrame, length: int, buckets: int) -> np.ndarray:
    """How many suffixes have a prefix in each bucket, for each prefix length; summed per task, then per length."""
    sizes = levels(length)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sizes), buckets), np.int64)
        for b in batches:
            for t in texts(b.column(1)):
                hashes, first, _ = _suffixes(t, length)
                for k, size in enumerate(sizes):
                    if len(first):
                        total[k] += np.bincount(_bucket(window_hashes(hashes, size)[first], buckets), minlength=buckets)
        yield pa.record_batch([pa.array(np.arange(len(sizes))), pa.array([x.tobytes() for x in total], pa.binary())], ["level", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(counts, np.int64)
        for k, x in total.items():
            yield pa.record_batch([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["level", "counts"])

    kind = "level long, counts binary"
    out = np.zeros((len(sizes), buckets), np.int64)
    for r in docs.mapInArrow(own, kind).repartition("level").mapInArrow(add, kind).collect():  # one row per prefix length
        out[r["level"]] = np.frombuffer(r["counts"], np.int64)
    return out


def dealt(counts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix length and bucket: whether its prefixes are too frequent and must be longer, and the task that gets it.

    A bucket of a longer prefix counts suffixes of shorter prefixes too, so its true share is not larger than its count.
    """
    limit = max(1, min(GROUP, int(counts[0].sum()) // (4 * parts)))
    longer = counts > limit
    longer[-1] = False  # whole windows can't be told apart further, and are reduced before they are sent
    task = np.zeros(counts.shape, np.int32)
    load = np.zeros(parts, np.int64)
    for k in range(len(counts)):
        open_ = np.flatnonzero(~longer[k] & (counts[k] > 0))
        share = counts[k] if k == 0 else np.minimum(counts[k], max(1, int(counts[k - 1][longer[k - 1]].sum()) // max(1, len(open_))))
        for b in open_[np.argsort(-share[open_], kind="stable")].tolist():
            task[k, b] = load.argmin()
            load[task[k, b]] += share[b]
    return longer, task


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the highest bytes first, compressed."""
    planes = np.ascontiguousarray(x[:, None].view(np.uint8).reshape(len(x), -1)[:, ::-1].T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _grown(blob: bytes, kind: type) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], n * width, "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1)[::-1].T).view(kind).ravel()


def _packed(key: int, *columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([key], pa.int32()), *(pa.array([_shrunk(x)], pa.binary()) for x in columns)]


def _runs(doc_id: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked windows as runs of consecutive ones: document (two numbers), first window, number of windows."""
    order = np.lexsort((place, own, doc_id))
    doc_id, own, place = doc_id[order], own[order], place[order].astype(np.uint32)
    if not len(doc_id):
        return doc_id, own, place, place
    new = np.ones(len(doc_id), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (own[1:] != own[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    last = place[np.append(at[1:], len(place)) - 1]
    return doc_id[at], own[at], place[at], last - place[at] + 1


def apart(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``own``: a key of the text where rows of one ``doc_id`` have unlike texts, else 0."""
    docs = docs.select(number().alias("doc_id"), "text")
    texts_of = docs.select("doc_id", text_key().alias("own")).groupBy("doc_id").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    unlike = written(texts_of.where("low <> high").select("doc_id", F.lit(True).alias("unlike")), "unlike")
    if unlike.isEmpty():
        return docs.withColumn("own", F.lit(0).cast("long"))
    return docs.join(unlike, "doc_id", "left").select("doc_id", "text", F.when(F.col("unlike"), text_key()).otherwise(0).alias("own"))


def marks(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``own`` and the windows of the document that start earlier too, as runs (first, number), of ``docs(doc_id, text, own)``; a row per marked document."""
    spark, parts = docs.sparkSession, tasks(docs)
    sizes = levels(length)
    buckets = max(BUCKETS, 64 * parts)
    counts = prefix_counts(docs, length, buckets)
    parts = max(parts, -(-int(counts[0].sum()) // GROUP))
    sent = spark.sparkContext.broadcast(dealt(counts, parts))  # ``buckets`` numbers for each prefix length

    names = ["task", "docs", "keys", "of", "places", "windows"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer, task = sent.value
        for b in batches:
            numbers, keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in texts(b.column(1), PIECE_BYTES):
                hashes, first, doc = _suffixes(t, length)
                if not len(first):
                    continue
                ids, own_keys = (x[t.first : t.first + len(t)] for x in (numbers, keys))
                place = first - t.words[doc]
                window = window_hashes(hashes, length)[first]
                if ((ids[1:] < ids[:-1]) | ((ids[1:] == ids[:-1]) & (own_keys[1:] < own_keys[:-1]))).any():  # bring the windows in order of document, then position
                    order = np.lexsort((place, own_keys[doc], ids[doc]))
                    first, doc, place, window = first[order], doc[order], place[order], window[order]
                order = np.argsort(window, kind="stable")
                first, doc, place, window = first[order], doc[order], place[order], window[order]
                new = np.ones(len(window), bool)
                new[1:] = window[1:] != window[:-1]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = ~new & ((ids[doc] != ids[doc[lead]]) | (own_keys[doc] != own_keys[doc[lead]]) | (place != place[lead]))
                if later.any():
                    runs = _runs(ids[doc[later]], own_keys[doc[later]], place[later])
                    yield pa.record_batch([*_packed(int(runs[0][0] % parts), *runs), pa.nulls(1, pa.binary())], names)
                first, doc, place, window = first[new], doc[new], place[new], window[new]
                to = np.full(len(first), -1, np.int32)
                left = np.arange(len(first))
                for k, size in enumerate(sizes):
                    bucket = _bucket(window_hashes(hashes, size)[first[left]], buckets)
                    here = ~longer[k][bucket]
                    to[left[here]] = task[k][bucket[here]]
                    left = left[~here]
                order = np.argsort(to, kind="stable")  # the windows of a task stay sorted
                begin = np.searchsorted(to[order], np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(begin)).tolist():
                    own = order[begin[k] : begin[k + 1]]
                    used, of = np.unique(doc[own], return_inverse=True)
                    blobs = _packed(k, ids[used], own_keys[used], of.astype(np.uint32), place[own].astype(np.uint32), np.diff(window[own], prepend=np.uint64(0)))
                    yield pa.record_batch(blobs, names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        marked = [_runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for b in batches:
            for docs, keys, of, places, windows in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                docs, keys, of, places = _grown(docs, np.int64), _grown(keys, np.int64), _grown(of, np.uint32), _grown(places, np.uint32)
                if windows is None:  # marked where they were read: document, first window, number
                    marked.append((docs, keys, of, places))
                else:
                    held.append((np.cumsum(_grown(windows, np.uint64)), docs[of], keys[of], places))
        if held:
            window, doc_id, own_key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(window, kind="stable")
            same = window[order[1:]] == window[order[:-1]]
            deep = np.zeros(len(window), bool)  # suffixes below a node that has others too
            deep[1:] = same
            deep[:-1] |= same
            order = order[deep]
            window, doc_id, own_key, place = window[order], doc_id[order], own_key[order], place[order]
            order = np.lexsort((place, own_key, doc_id, window))
            window, doc_id, own_key, place = window[order], doc_id[order], own_key[order], place[order]
            new = np.ones(len(window), bool)
            new[1:] = window[1:] != window[:-1]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc_id != doc_id[lead]) | (own_key != own_key[lead]) | (place != place[lead])
            marked.append(_runs(doc_id[later], own_key[later], place[later]))
        doc_id, own_key, first, number_ = (np.concatenate(x) for x in zip(*marked, strict=True))
        to = (doc_id ^ own_key) % parts
        order = np.argsort(to, kind="stable")
        begin = np.searchsorted(to[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(begin)).tolist():
            own = order[begin[k] : begin[k + 1]]
            yield pa.record_batch(_packed(k, doc_id[own], own_key[own], first[own], number_[own]), ["task", "docs", "keys", "first", "number"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(_grown(x, kind) for x, kind in zip(row, (np.int64, np.int64, np.uint32, np.uint32), strict=True)) for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)]
        if not found:
            return
        doc_id, own_key, first, number_ = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((first, own_key, doc_id))
        doc_id, own_key, runs = doc_id[order], own_key[order], np.stack([first, number_], axis=1)[order].astype("<u4")
        begin = np.flatnonzero(np.append(True, (doc_id[1:] != doc_id[:-1]) | (own_key[1:] != own_key[:-1])))
        blobs = [runs[lo:hi].tobytes() for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(runs)], strict=True)]
        yield pa.record_batch([pa.array(doc_id[begin]), pa.array(own_key[begin]), pa.array(blobs, pa.binary())], ["doc_id", "own", "runs"])

    sent_rows = docs.mapInArrow(send, "task int, docs binary, keys binary, of binary, places binary, windows binary").repartitionById(parts, F.col("task"))
    by_doc = sent_rows.mapInArrow(meet, "task int, docs binary, keys binary, first binary, number binary").repartitionById(parts, F.col("task"))
    return by_doc.mapInArrow(gather, "doc_id long, own long, runs binary")


def without_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (first word and end of each maximal repeated span) and ``kept`` (the other words, joined by blanks).

    A word is in a span if a window of ``length`` words that covers it also starts earlier: in a document of smaller ``doc_id``, or before in its own.
    """
    docs = apart(docs)
    joined = docs.join(marks(docs, length).hint("merge"), ["doc_id", "own"], "left").select("doc_id", "text", "runs")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                rows = slice(t.first, t.first + len(t))
                words = np.diff(t.words)
                change = np.zeros(len(t.starts) + 1, np.int64)
                for low, blob in zip(t.words.tolist(), b.column(2)[rows].to_pylist(), strict=False):
                    if blob is not None:
                        run = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                        np.add.at(change, low + run[:, 0], 1)
                        np.add.at(change, low + run[:, 0] + run[:, 1] - 1 + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                yield pa.record_batch([b.column(0)[rows], pa.array(words), _spans(gone, t), _kept(gone, t)], ["doc_id", "n_words", "spans", "kept"])

    return joined.mapInArrow(of, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string").withColumn("doc_id", given())


def _spans(gone: np.ndarray, t: Texts) -> pa.Array:
    """Runs of removed words in each text, numbered from the text's first word."""
    doc = np.repeat(np.arange(len(t)), np.diff(t.words))
    opens, closes = gone.copy(), gone.copy()
    if len(gone):
        other = doc[1:] != doc[:-1]
        opens[1:] &= ~gone[:-1] | other
        closes[:-1] &= ~gone[1:] | other
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    base = t.words[:-1][doc[start]]
    items = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end + 1 - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[start], np.arange(len(t) + 1)), pa.int32()), items)


def _kept(gone: np.ndarray, t: Texts) -> pa.Array:
    """The other words of each text, joined by one blank."""
    if not len(t.starts):
        return pa.array([""] * len(t), pa.string())
    doc = np.repeat(np.arange(len(t)), np.diff(t.words))
    kept = np.flatnonzero(~gone)
    more = np.zeros(len(kept), bool)  # whether a kept word of the same text follows
    more[:-1] = doc[kept[1:]] == doc[kept[:-1]]
    data = np.where(WHITE[t.data], np.uint8(0x20), t.data)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, t.starts[kept], 1)
    np.add.at(edge, t.ends[kept] + more, -1)  # the white character after a word stands for the blank
    on = np.cumsum(edge[:-1], dtype=np.int8) > 0
    length = np.bincount(doc[kept], (t.ends - t.starts)[kept] + more, len(t)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(t), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[on])))
